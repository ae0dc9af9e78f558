"""From scores and vectors of frames to words, spans and codes, with the command too."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import cli
from corpusloom.operators import cluster, pronounce
from corpusloom.plans import config

#: A vocabulary in its own script: the blank, a space and letters.
SYMBOLS = {c: i for i, c in enumerate(["<blank>", "|", *"ابتجدرسمنعلك"])}


def spoken(text, rng, frames_each=3):
    """Scores of frames that say a text: frames_each for each character, and one of the blank after each."""
    path = [s for c in text for s in [SYMBOLS["|" if c == " " else c]] * frames_each + [0]]
    scores = np.full((len(path) + 1, len(SYMBOLS)), -6.0) + rng.normal(0, 0.1, (len(path) + 1, len(SYMBOLS)))
    scores[np.arange(len(path)), path] = -0.1
    scores[-1, 0] = -0.1
    return scores.tolist()


def corpus(spark, n):
    rng = np.random.default_rng(5)
    texts = ["علم كتاب" if i % 2 else "كتاب علم سم" for i in range(n)]
    scores = [(f"u{i}", spoken(t, rng)) for i, t in enumerate(texts)]
    rows = [(f"u{i}", t, len(s) / 50) for i, (t, (_, s)) in enumerate(zip(texts, scores, strict=True))]
    frames = []
    for i, (_, s) in enumerate(scores):
        side = 4.0 if i % 3 == 0 else -4.0  # two pronunciations of every word
        frames += [(f"u{i}", t, (rng.normal(0, 0.3, 4) + [0, side if t < len(s) // 3 else -side, 0, 0]).tolist()) for t in range(len(s))]
    make = spark.createDataFrame
    return make(rows, "uid string, text string, duration double"), make(scores, "uid string, scores array<array<double>>"), make(frames, "uid string, t int, vector array<double>")


def test_words_stand_where_they_are_said(spark):
    manifest, scores, _ = corpus(spark, 2)
    more = manifest.unionByName(spark.createDataFrame([("none", "علم", 1.0), ("short", "كتاب علم", 1.0), ("latin", "abc", 1.0)], manifest.schema))
    odd = scores.unionByName(spark.createDataFrame([("short", [[0.0] * len(SYMBOLS)] * 3), ("latin", [[0.0] * len(SYMBOLS)] * 30)], scores.schema))
    got = sorted((r.uid, r.word_index, r.word, round(r.start * 50), round(r.end * 50)) for r in pronounce.align_words(more, odd, SYMBOLS).collect())
    # four frames a character, the last of them the blank
    assert got == [("u0", 0, "كتاب", 0, 15), ("u0", 1, "علم", 20, 31), ("u0", 2, "سم", 36, 43), ("u1", 0, "علم", 0, 11), ("u1", 1, "كتاب", 16, 31)]


def test_codes_of_words(spark):
    manifest, scores, frames = corpus(spark, 60)
    words = pronounce.align_words(manifest, scores, SYMBOLS)
    vectors = pronounce.word_vectors(words, frames, 50.0, 4)
    assert vectors.count() == 150 and {len(r.vector) for r in vectors.collect()} == {4}
    codes = pronounce.word_codes(vectors, cluster.Clustering(min_word_freq=20, n_bootstrap=4, pca_dim=2)).collect()
    assert {r.word for r in codes} == {"علم", "كتاب", "سم"} and len(codes) == 150
    several = {r.word for r in codes if r.n_codes > 1}
    assert several
    for word in several:  # a code goes with a side
        sides = {(r.code, int(r.uid[1:]) % 3 == 0, r.word_index) for r in codes if r.word == word}
        assert len({(c, i) for c, _, i in sides}) == len(sides)


def test_command_with_scores(spark, tmp_path):
    manifest, scores, frames = corpus(spark, 24)
    (tmp_path / "c").mkdir()
    manifest.select(F.col("uid").alias("id"), F.concat("uid", F.lit(".wav")).alias("path"), "text", F.lit(1.5).alias("duration")).coalesce(1).write.json(str(tmp_path / "c/metadata/all.jsonl"))
    scores.write.parquet(str(tmp_path / "scores"))
    frames.write.parquet(str(tmp_path / "frames"))
    (tmp_path / "symbols.json").write_text(json.dumps(SYMBOLS, ensure_ascii=False), encoding="utf-8")
    settings = config.Config(discovery=config.Discovery(min_word_freq=8, n_bootstrap=2))
    given = {"scores": str(tmp_path / "scores"), "symbols": str(tmp_path / "symbols.json"), "frames": str(tmp_path / "frames")}
    tables = cli.run(spark, str(tmp_path / "c"), str(tmp_path / "o"), settings=settings, verbal=False, fps=33.0, **given)
    assert list(tables) == [*cli.STAGES, *cli.SPOKEN]
    assert tables["alignments"].count() == tables["spans"].count() == tables["codes"].count() == 60
    assert {r.word for r in tables["codes"].select("word").distinct().collect()} == {"علم", "كتاب", "سم"}
    with pytest.raises(ValueError, match="needs scores"):
        cli.run(spark, str(tmp_path / "c"), str(tmp_path / "o"), "codes")
