"""Vectors of words: pooling, joining with labels, teachers, evaluation losses, sampling, and choices that a user marks."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars, marks
from ..session import materialize
from .intervals import points_in_intervals


def fit_length(vectors: Column, n: Column, dim: int) -> Column:
    """An array of n vectors: cut, or filled up with zeros; a null array is all zeros."""
    zero = F.array_repeat(F.lit(0.0), dim)
    held = F.coalesce(vectors, F.array().cast("array<array<double>>"))
    return F.slice(F.concat(held, F.array_repeat(zero, F.greatest(n - F.size(held), F.lit(0)).cast("int"))), F.lit(1), n.cast("int"))


def label_vectors(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """labels (uid, idx, code) with the vector of their word from (uid, vectors); words beyond the array's end are left out."""
    rows = labels.join(vectors, "uid").withColumn("vector", F.get("vectors", F.col("idx").cast("int")))
    return rows.where("vector is not null").select("uid", "idx", "code", "vector")


def mean_by(rows: DataFrame, keys: list[str], vector: str, dim: int) -> DataFrame:
    """Mean vector of each key, without exploding."""
    return rows.groupBy(*keys).agg(F.array(*[F.avg(F.get(vector, F.lit(i))) for i in range(dim)]).alias("mean"), F.count("*").alias("n"))


def span_means(frames: DataFrame, spans: DataFrame, fps: float, pad: float, dim: int) -> DataFrame:
    """uid, word_index, mean: frames (uid, t, vector) of each padded span of seconds, less the utterance's mean.

    Frames from floor((start - pad) * fps) to ceil((end + pad) * fps), one at least; spans beyond the last frame give zeros. Frames
    meet spans by an interval join, so the work follows the frames inside of spans, however long an utterance is.
    """
    whole = mean_by(frames, ["uid"], "vector", dim).withColumnRenamed("mean", "own").withColumnRenamed("n", "n_frames")
    low = F.greatest(F.lit(0), F.floor((F.col("start") - pad) * fps)).cast("int")
    high = F.least(F.col("n_frames"), F.ceil((F.col("end") + pad) * fps)).cast("int")
    cut = spans.join(whole, "uid").withColumn("a", low).withColumn("b", F.when(high <= F.col("a"), F.least(F.col("n_frames"), F.col("a") + 1)).otherwise(high))
    cut = materialize(cut.select("uid", "word_index", "a", "b", "own"), "spans")
    inside = points_in_intervals(frames.select("uid", "t", "vector"), cut.select("uid", "word_index", "a", "b"), ["uid"], "t", "a", "b")
    means = mean_by(inside, ["uid", "word_index"], "vector", dim).drop("n")
    own = cut.dropDuplicates(["uid", "word_index"]).select("uid", "word_index", "own")
    got = means.join(own, ["uid", "word_index"]).select("uid", "word_index", F.zip_with("mean", "own", lambda x, o: x - o).alias("mean"))
    return spans.select("uid", "word_index").join(got, ["uid", "word_index"], "left").withColumn("mean", F.coalesce("mean", F.array_repeat(F.lit(0.0), dim)))


def spans_of_path(path: Column, scores: Column, n_targets: Column) -> Column:
    """array of (start, end, score): the frames in which a path stands in the state of each target, and their mean score; -1 without frames."""

    def one(i):
        at = F.filter(F.transform(path, lambda s, t: F.when(s == 2 * i + 1, t)), lambda t: t.isNotNull())
        start, end = F.array_min(at), F.array_max(at) + 1
        held = F.slice(scores, start + 1, end - start)
        mean = F.aggregate(held, F.lit(0.0), lambda acc, x: acc + x) / F.size(held)
        return F.when(F.size(at) > 0, F.struct(start.alias("start"), end.alias("end"), mean.alias("score"))).otherwise(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(float("-inf")).alias("score")))

    return F.transform(F.sequence(F.lit(0), n_targets - 1), one)


def teacher_logits(vector: Column, mean: list[float], sd: list[float], weights: list[list[float]], bias: list[float]) -> Column:
    """Scores of a linear head over a standardised vector."""
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    z = F.zip_with(F.zip_with(vector, arr(mean), lambda x, m: x - m), arr(sd), lambda x, s: x / s)
    return F.array(*[F.aggregate(F.zip_with(z, arr(w), lambda a, b: a * b), F.lit(float(b)), lambda acc, x: acc + x) for w, b in zip(weights, bias, strict=True)])


def fit_teacher(rows: DataFrame, vector: str, code: str, penalty: float = 2e-4, least: int = 32):
    """A multinomial logistic head, standardised inside; None for fewer than `least` rows."""
    held = rows.where(F.col(code) >= 0).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(code).cast("double").alias("label"))
    if held.limit(least).count() < least:
        return None
    return LogisticRegression(family="multinomial", regParam=penalty, maxIter=200, standardization=True).fit(held)


def cross_entropy(probs: Column, target: Column, legal: Column, smoothing: float = 0.02) -> Column:
    """Loss of one row: smoothed over its legal codes."""
    logs = F.transform(F.slice(probs, 1, legal), lambda p: F.log(F.greatest(p, F.lit(1e-30))))
    mean = F.aggregate(logs, F.lit(0.0), lambda acc, x: acc + x) / legal
    return -((1 - smoothing) * F.get(logs, target) + smoothing * mean)


def soft_divergence(logits: Column, teacher: Column, legal: Column, temperature: float = 2.0) -> Column:
    """Temperature-scaled Kullback-Leibler divergence of a teacher's distribution from a row's own, over the legal codes."""

    def log_soft(x: Column) -> Column:
        scaled = F.transform(F.slice(x, 1, legal), lambda v: v / temperature)
        top = F.array_max(scaled)
        total = F.log(F.aggregate(F.transform(scaled, lambda v: F.exp(v - top)), F.lit(0.0), lambda acc, v: acc + v))
        return F.transform(scaled, lambda v: v - top - total)

    parts = F.zip_with(log_soft(teacher), log_soft(logits), lambda t, s: F.exp(t) * (t - s))
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v) * temperature * temperature


def cosine_loss(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    return 1 - dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-8))


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    t = F.least(F.greatest(target, F.lit(0.0)), F.lit(1.0))
    return F.greatest(logit, F.lit(0.0)) - logit * t + F.log1p(F.exp(-F.abs(logit)))


def greedy(rows: DataFrame, key: str, item: str, share: str) -> DataFrame:
    """key, item: the item of each key with the largest share, the least of equal ones."""
    best = F.min_by(item, F.struct(-F.col(share), item))
    return rows.groupBy(key).agg(best.alias(item))


def draw(rows: DataFrame, key: str, item: str, share: str, seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """key, item: one item of each key, drawn by its share to the power 1 / temperature; without temperature the greedy one.

    The draw is a hash of the key, so reruns agree.
    """
    if temperature <= 0:
        return greedy(rows, key, item, share)
    if temperature != 1:
        rows = rows.withColumn(share, F.pow(share, F.lit(1 / temperature)))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    w = Window.partitionBy(key).orderBy(F.desc(share), item)
    upto = rows.withColumn("__c", F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__t", F.sum(share).over(Window.partitionBy(key)))
    hit = upto.where(F.col("__c") > u * F.col("__t"))
    return hit.groupBy(key).agg(F.min_by(item, F.struct("__c", item)).alias(item))


def split_marks(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """uid, idx, bare, code, reason, variants of each word of rows (uid, text): marks go, and where they choose a reading its code stays.

    code: -1 with a reason if marks don't resolve; null if there are none or the word has one reading.
    """
    words = texts.select("uid", F.posexplode(chars.split_spaces(F.col("text"))).alias("idx", "token"))
    found = marks.partial_codes(words, lexicon)
    given = F.exists(marks.letter_marks(F.col("token")), lambda p: p["marks"] != "")
    bare = chars.strip_label_marks(F.col("token"))
    v = marks.letter_variants(marks.normalize_variant_marks(F.col("token")))
    got = found.join(lexicon.select("word", F.size("patterns").alias("n_codes")), chars.word_identity(F.col("token")) == F.col("word"), "left")
    code = F.when(given & ((F.col("code") < 0) | (F.col("n_codes") > 1)), F.col("code"))
    return got.select("uid", "idx", bare.alias("bare"), code.alias("code"), F.when(given & (F.col("code") < 0), F.col("reason")).alias("reason"), F.when(F.size(v) == F.length(bare), v).otherwise(F.array_repeat(F.lit(0), F.length(bare))).alias("variants"))


def aligned_words(manifest: DataFrame, alignments: DataFrame) -> DataFrame:
    """The manifest's columns with word_index, word, start, end, score of each aligned word of (uid, words).

    Utterances without an alignment, or with an empty one, are left out.
    """
    return manifest.join(alignments, "uid").select(*manifest.columns, F.inline("words"))
