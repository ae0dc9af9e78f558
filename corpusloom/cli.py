"""Stages of a corpus folder as a command: python -m corpusloom.cli CORPUS OUT [--stage S] [--force] [--force-upstream] [--limit N]
[--config FILE] [--no-verbal] [--audio] [--marked FILE]
[--scores TABLE --symbols FILE [--frames TABLE --fps N]]."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vocab
from .operators import corpus as C
from .operators import manifest, pronounce, readings, sequences
from .operators.cluster import Clustering
from .plans import config
from .plans.report import log, stage
from .session import get_spark
from .sources import pcm, readers, sinks

STAGES = ["manifest", "vocab", "lexicon", "labels", "variants", "report"]
#: Stages that run where their inputs are given: scores of frames and their symbols, and vectors of frames.
SPOKEN = ["alignments", "spans", "codes"]


def forced(name: str, asked: str, force: bool, upstream: bool) -> bool:
    """Whether a stage is made again: force means the stage asked for, and those before it only with upstream or for all."""
    return force and (asked in ("all", name) or upstream)


def marked_rows(spark: SparkSession, corpus: str, rows: DataFrame, marked: str | None) -> DataFrame:
    """uid, text, diacritized: the marked transcripts in a JSON lines table, or else the manifest's raw text as its own marked form.

    Marked rows whose uid the manifest doesn't hold are left out; they keep the plain text that they were marked from.
    """
    path = marked or f"{corpus}/diacritized.jsonl"
    if not readers.exists(spark, path):
        if marked:
            raise FileNotFoundError(f"no marked transcripts in {marked}")
        return rows.select("uid", "text", F.col("raw").alias("diacritized"))
    table = readers.read_jsonl(spark, path, "uid string, text string, diacritized string")
    return table.join(rows.select("uid"), "uid", "left_semi")


def run(
    spark: SparkSession, corpus: str, out: str, asked: str = "all", force: bool = False, upstream: bool = False, limit: int = 0, settings: config.Config | None = None, verbal: bool = True, audio: bool = False, marked: str | None = None,
    scores: str | None = None, symbols: str | None = None, frames: str | None = None, fps: float = 50.0,
) -> dict[str, DataFrame]:
    """The tables of the stage asked for and of those before it; each is made once and then read again.

    verbal: numbers, addresses and Latin words are spoken. audio: rows without a recording are skipped, and missing durations are read
    from headers. marked: a JSON lines table of marked transcripts. scores and frames: Parquet tables (uid, scores) and (uid, t, vector);
    symbols: the scores' vocabulary, a JSON object of symbols and ids.
    """
    settings = settings or config.Config()
    d = settings.discovery
    gates = readings.Gates(d.min_word_freq, d.min_pattern_count, d.min_pattern_frac, d.max_codes, d.max_raw_patterns, d.min_context_agreement)
    tables: dict[str, DataFrame] = {}

    def make_manifest(path: str) -> None:
        rows = readers.read_corpus(spark, corpus)
        rows = C.with_reasons(C.normalised(pcm.located(rows, corpus) if audio else rows, settings.text, verbal), settings.text)
        rows = manifest.first_rows(rows, ["uid"], limit)
        found = sinks.write_observed(rows.drop("missing"), f"{path}.kept", C.metrics(), C.refuse_empty, keep=F.col("skip_reason").isNull())
        for line in C.summary(found):
            log.info(line)
        kept = spark.read.parquet(f"{path}.kept").drop("skip_reason")
        split = manifest.assign_splits(kept.where("split is null").select("uid").distinct(), "uid").select("uid", F.col("split").alias("drawn"))
        kept = kept.join(split, "uid", "left").withColumn("split", F.coalesce("split", "drawn")).drop("drawn")
        kept.write.mode("overwrite").parquet(path)

    pairs = lambda: marked_rows(spark, corpus, tables["manifest"], marked)
    make: dict[str, Callable[[], DataFrame]] = {
        "vocab": lambda: vocab.char_vocab(manifest.keep_splits(tables["manifest"], "train", empty=False).select("text")),
        "lexicon": lambda: readings.mine(C.marked_occurrences(pairs()), gates),
        "labels": lambda: readings.labels(C.marked_occurrences(pairs()), tables["lexicon"]).where("code >= 0"),
        "variants": lambda: C.marked_variants(pairs()),
    }
    if scores and symbols:
        with open(symbols, encoding="utf-8") as f:
            vocabulary = json.load(f)
        a = settings.align
        spoken = lambda: sequences.span_filter(pronounce.align_words(tables["manifest"], spark.read.parquet(scores), vocabulary), a.min_word, a.max_word, a.min_score)
        make["alignments"] = lambda: spoken().where("kept").drop("kept")
    if "alignments" in make and frames:
        table = spark.read.parquet(frames)
        dim = table.select(F.size("vector").alias("n")).first()
        make["spans"] = lambda: pronounce.word_vectors(tables["alignments"], table, fps, dim.n if dim else 1)
        fields = {f: getattr(d, f) for f in Clustering.__dataclass_fields__ if hasattr(d, f)}
        make["codes"] = lambda: pronounce.word_codes(tables["spans"], Clustering(**fields))
    stages = [*STAGES, *(s for s in SPOKEN if s in make)]
    if asked not in ("all", *stages):
        raise ValueError(f"stage {asked} needs scores and symbols, and spans and codes need frames too")
    for name in stages[: len(stages) if asked == "all" else stages.index(asked) + 1]:
        path, again = f"{out}/{name}", forced(name, asked, force, upstream)
        with stage(name):
            if name == "manifest":
                if again or not readers.exists(spark, f"{path}/_SUCCESS"):
                    make_manifest(path)
                tables[name] = spark.read.parquet(path)
            elif name == "report":
                if again or not readers.exists(spark, f"{path}/_SUCCESS"):
                    sinks.reading_report(readings.nested(tables["lexicon"]), path)
                tables[name] = spark.read.text(path)
            else:
                tables[name] = sinks.cached_table(spark, path, make[name], again)
    return tables


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Prepare a corpus folder stage by stage")
    p.add_argument("corpus")
    p.add_argument("out")
    p.add_argument("--stage", default="all", choices=["all", *STAGES, *SPOKEN])
    p.add_argument("--force", action="store_true", help="make the stage again even if its table is there")
    p.add_argument("--force-upstream", action="store_true", help="with --force: the stages before it too")
    p.add_argument("--limit", type=int, default=0, help="trial run on the first N utterances")
    p.add_argument("--config", help="settings of the text and the discovery, as JSON")
    p.add_argument("--no-verbal", action="store_true", help="leave numbers, addresses and Latin words as they are")
    p.add_argument("--audio", action="store_true", help="skip rows without a recording, and read missing durations from headers")
    p.add_argument("--marked", help="marked transcripts: uid, text, diacritized as JSON lines")
    p.add_argument("--scores", help="frames' scores of symbols (uid, scores) as Parquet, for alignments")
    p.add_argument("--symbols", help="the scores' vocabulary as JSON")
    p.add_argument("--frames", help="frames' vectors (uid, t, vector) as Parquet, for spans and codes")
    p.add_argument("--fps", type=float, default=50.0, help="frames of --frames in a second")
    a = p.parse_args(args)
    run(get_spark("corpusloom"), a.corpus, a.out, a.stage, a.force, a.force_upstream, a.limit, config.load(a.config) if a.config else None, not a.no_verbal, a.audio, a.marked, a.scores, a.symbols, a.frames, a.fps)


if __name__ == "__main__":
    main()
