"""Writing corpus tables, and tables that are made once and then read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def write_manifest(df: DataFrame, path: str) -> None:
    """Parquet by split, so that readers of one split open only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cached_table(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, made and written if it isn't there or force is set."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def alignment_rows(spans: DataFrame) -> DataFrame:
    """uid, words: spans (uid, word_index, word, start, end, score) nested by utterance, rounded to four digits."""
    word = F.struct("word_index", "word", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), F.round("score", 4).alias("score"))
    return spans.groupBy("uid").agg(F.array_sort(F.collect_list(word)).alias("words"))  # the words of one utterance


def label_keys(labels: DataFrame) -> DataFrame:
    """key, code: uid and position joined by a tab."""
    return labels.select(F.concat_ws("\t", F.col("uid").cast("string"), F.col("pos").cast("string")).alias("key"), "code")


def parse_label_keys(rows: DataFrame) -> DataFrame:
    parts = F.split("key", "\t")
    return rows.select(F.get(parts, F.lit(0)).alias("uid"), F.get(parts, F.lit(1)).cast("int").alias("pos"), "code")


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Put a written folder in the place of another."""
    jvm = spark.sparkContext._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    store = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(b, True)
    if not store.rename(a, b):
        raise OSError(f"{source} can't be renamed to {target}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_observed(rows: DataFrame, path: str, metrics: dict[str, Column], accept: Callable[[dict], str | None] = lambda m: None, keep: Column | None = None, partition_by: str | None = None) -> dict:
    """Write rows as Parquet and return the metrics (aggregates by name) seen by that very write; nothing is scanned again.

    With keep only the rows for which it holds are written; metrics see all.

    accept gets them before the table takes its place: if it returns a reason, the written files go, whatever stood at path stays, and
    a ValueError says why. Metrics see what rows hold when they are written, so rows should not come from a source that changes.
    """
    seen = Observation()
    out = rows.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    return _write_seen(out if keep is None else out.where(keep), path, lambda: dict(seen.get), accept, partition_by)


def _write_seen(out: DataFrame, path: str, get: Callable[[], dict], accept: Callable[[dict], str | None], partition_by: str | None) -> dict:
    spark, apart = out.sparkSession, f"{path.rstrip('/')}.writing-{uuid.uuid4().hex[:8]}"
    writer = out.write.mode("overwrite")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(apart)
        found = get()
        if reason := accept(found):
            raise ValueError(reason)
        _move(spark, apart, path)
    except BaseException:
        _delete(spark, apart)
        raise
    return found


def write_external(source: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str) -> dict:
    """Write apply(source), an external pass that must not lose or add rows: n_read and n_written are counted as they pass by.

    If they differ nothing is written. apply must read its input once: a join with itself would count it twice.
    """
    read, written = Observation(), Observation()
    out = apply(source.observe(read, F.count(F.lit(1)).alias("n"))).observe(written, F.count(F.lit(1)).alias("n"))

    def differ(m: dict) -> str | None:
        return None if m["n_read"] == m["n_written"] else f"{m['n_written']} rows written for {m['n_read']} read"

    return _write_seen(out, path, lambda: {"n_read": read.get["n"], "n_written": written.get["n"]}, differ, None)


LEXICON = "word string, patterns array<string>, counts array<long>, examples array<string>, total long"


def save_lexicon(lexicon: DataFrame, path: str) -> None:
    """A nested lexicon (a row for each word) as JSON lines."""
    lexicon.write.mode("overwrite").json(path)


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEXICON).json(path)


MODELS = "word string, n long, n_codes int, stability double, silhouette double, separation double, mean array<double>, axes array<array<double>>, scale double, centroids array<array<double>>"


def save_models(models: DataFrame, path: str) -> None:
    """Pronunciation models, a row for each word, as JSON lines; numbers keep all their digits."""
    models.write.mode("overwrite").json(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """What save_models() wrote. Raises for a model whose axes, mean and centroids don't fit together, once it is read."""
    rows = spark.read.schema(MODELS).json(path)
    wide = F.size(F.get("axes", F.lit(0)))
    fits = F.col("axes").isNull() | ((wide == F.size("mean")) & (F.size("axes") == F.size(F.get("centroids", F.lit(0)))) & (F.size("centroids") == F.col("n_codes")))
    bad = F.raise_error(F.concat(F.lit("the model of "), F.col("word"), F.lit(" doesn't fit together")))
    return rows.withColumn("n_codes", F.when(F.coalesce(fits, F.lit(False)), F.col("n_codes")).otherwise(bad.cast("int")))


def save_variants(rows: DataFrame, path: str) -> None:
    """uid, variants of rows (uid, variants array<int>): one digit for each character, as a string."""
    digits = F.array_join(F.col("variants").cast("array<string>"), "")
    odd = F.exists("variants", lambda v: v.isNull() | (v < 0) | (v > 9))
    bad = F.raise_error(F.concat(F.lit("a variant of "), F.col("uid").cast("string"), F.lit(" is no digit")))
    rows.select("uid", F.when(odd, bad.cast("string")).otherwise(digits).alias("variants")).write.mode("overwrite").json(path)


def load_variants(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """uid, variants (array<int>) of texts (uid, text): zeros where nothing was saved, or a string of another length than the text."""
    kind = texts.schema["uid"].dataType.simpleString()
    saved = spark.read.schema(f"uid {kind}, variants string").json(path).withColumnRenamed("variants", "saved")
    zeros = F.array_repeat(F.lit(0), F.length("text"))
    own = F.when(F.length("saved") == F.length("text"), F.transform(F.split("saved", ""), lambda c: c.cast("int"))).otherwise(zeros)
    return texts.select("uid", "text").join(saved, "uid", "left").select("uid", F.when(F.length("text") > 0, own).otherwise(F.array().cast("array<int>")).alias("variants"))


def reading_report(lexicon: DataFrame, path: str, limit: int = 200) -> None:
    """A text file of the most frequent ambiguous words of a nested lexicon: the word, how often it stands, and a line for each reading."""
    share = lambda n: F.format_string("%5.1f%%", 100.0 * n / F.col("total"))
    lines = F.transform(F.arrays_zip("patterns", "counts", "examples"), lambda r, i: F.concat(F.lit("    "), i.cast("string"), F.lit("  "), F.rpad(r["examples"], 20, " "), F.lpad(r["counts"].cast("string"), 8, " "), F.lit("  "), share(r["counts"])))
    several = lexicon.where(F.size("patterns") > 1)
    top = several.orderBy(F.desc("total"), "word").limit(limit)
    head = F.concat(F.col("word"), F.lit("  "), F.col("total").cast("string"), F.lit(" uses, "), F.size("patterns").cast("string"), F.lit(" readings"))
    # one file in order: the limit bounds it
    top.select("total", "word", F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("value")).repartition(1).sortWithinPartitions(F.desc("total"), "word").select("value").write.mode("overwrite").text(path)
