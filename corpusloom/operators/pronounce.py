"""From frames to pronunciations: words aligned with recordings, a vector for each word, and codes found among a word's vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars, translit, vocab
from . import cluster, features, sequences
from .alignment import blank_of, forced_align, is_romanised


def align_words(manifest: DataFrame, scores: DataFrame, vocabulary: dict[str, int], pad_id: int | None = None) -> DataFrame:
    """uid, word_index, word, start, end, score (seconds, mean log-probability) of the words of a manifest (uid, text, duration).

    scores: uid, scores (frames x symbols of the vocabulary). Texts are romanised if the vocabulary lacks their script. Utterances
    without scores, or that can't be aligned, and words none of whose characters has a frame give no row.
    """
    targets = translit.alignment_targets(F.col("text"), vocabulary) if is_romanised(vocabulary) else translit.native_targets(F.col("text"), vocabulary)
    rows = manifest.select("uid", "text", F.col("duration").cast("double").alias("duration"), targets.alias("t"))
    paths = forced_align(rows.join(scores.select("uid", "scores"), "uid").select("uid", "scores", F.transform("t", lambda x: x["id"].cast("int")).alias("targets")), blank_of(vocabulary, pad_id))
    frames = scores.select("uid", F.size("scores").alias("frames"))
    held = rows.join(paths.where(F.size("spans") > 0), "uid").join(frames, "uid").withColumn("words", chars.word_spans(F.col("text")))
    index = vocab.word_index(F.col("text"), F.col("words"))
    timed = sequences.frames_to_seconds(F.col("spans"), F.col("frames"), F.col("duration"))
    each = held.select("uid", "words", index.alias("index"), F.explode(F.arrays_zip(F.col("t").alias("t"), timed.alias("s"))).alias("x"))
    letters = each.select("uid", F.get("index", F.col("x.t.source")).alias("word_index"), F.get("words", F.get("index", F.col("x.t.source")))["word"].alias("word"), "x.s.*")
    got = sequences.word_spans(letters.where("word_index >= 0"), ["uid", "word_index", "word"])
    return got.select("uid", "word_index", "word", "start", "end", "score")


def word_vectors(words: DataFrame, frames: DataFrame, fps: float, dim: int, pad: float = 0.02) -> DataFrame:
    """uid, word_index, word, seconds, vector of aligned words: the mean of the frames (uid, t, vector) of each padded span, less its utterance's."""
    means = features.span_means(frames, words.select("uid", "word_index", "start", "end"), fps, pad, dim)
    rows = words.join(means, ["uid", "word_index"])
    return rows.select("uid", "word_index", "word", (F.col("end") - F.col("start")).alias("seconds"), F.col("mean").alias("vector"))


def word_codes(vectors: DataFrame, params: cluster.Clustering = cluster.Clustering()) -> DataFrame:
    """uid, word_index, word, code and the split's quality of every occurrence of a word, told by its identity, that is frequent enough."""
    named = vectors.select("uid", "word_index", chars.word_identity(F.col("word")).alias("word"), "seconds", "vector", F.xxhash64(F.col("uid").cast("string"), "word_index").alias("occurrence"))
    rows = named.select("word", F.col("occurrence").alias("uid"), "vector", "seconds")
    found = cluster.discover_codes(rows, params).withColumnRenamed("uid", "occurrence")
    return named.select("uid", "word_index", "occurrence", "word").join(found, ["occurrence", "word"]).drop("occurrence")
