"""Vectors and scores: normalising, distances, cluster measures, entropy, depth routing, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side

TAU_LOW, TAU_HIGH = 0.15, 0.45


def l2_normalize(v: Column, eps: float = 1e-8) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.transform(v, lambda x: x.cast("double") / (norm + eps))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x)


def centroids(rows: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """group, centroid, n: means by position, aggregated without exploding vectors."""
    means = F.array(*[F.avg(F.get(vector, F.lit(i)).cast("double")) for i in range(dim)])
    return rows.groupBy(group).agg(means.alias("centroid"), F.count("*").alias("n"))


#: Centroids that one row holds: all rows of a task meet such a row at once.
CENTROIDS = 4096


def _held(table: DataFrame, group: str) -> list[DataFrame]:
    """A table of centroids as frames of one row, each with an array of about CENTROIDS of them at most."""
    n = max(1, -(-table.count() // CENTROIDS))
    if n > 1:
        table = materialize(table.withColumn("__block", F.pmod(F.xxhash64(group), F.lit(n))), "centroids")
    entries = F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col("centroid").alias("c")))).alias("cs")
    return [(table.where(F.col("__block") == i) if n > 1 else table).agg(entries) for i in range(n)]


def nearest(rows: DataFrame, uid: str, vector: str, table: DataFrame, group: str, other_than: str | None = None) -> DataFrame:
    """uid, nearest, d2: the closest centroid of a table, the lowest of equals; with other_than not the one of the row's own group.

    Centroids meet the rows in blocks of CENTROIDS, each broadcast as one array, not as a join of pairs. With more than one block, rows of
    one uid count as one row.
    """
    found = None
    for held in _held(table, group):
        got = rows.crossJoin(F.broadcast(held))  # one row
        others = F.filter("cs", lambda x: x["g"] != F.col(other_than)) if other_than else F.col("cs")
        best = F.array_min(F.transform(others, lambda x: F.struct(squared_distance(F.col(vector), x["c"]).alias("d2"), x["g"].alias("g"))))
        got = got.select(F.col(uid), best.alias("b"))
        found = got if found is None else found.unionByName(got).groupBy(uid).agg(F.min("b").alias("b"))
    return found.select(uid, F.col("b.g").alias("nearest"), F.col("b.d2").alias("d2"))


def variance_explained(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Share of a value's variance between groups; 0 below four rows or without variance."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.var_pop(value).alias("v"), F.avg(value).alias("m"))
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    got = per.agg(total.alias("n"), F.sum(F.col("n") * F.col("v")).alias("inner"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"), mean.alias("mean"))
    between = F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")
    share = between / (F.col("inner") + between)
    return got.select("n", F.round(F.when((F.col("n") < 4) | (F.col("inner") + between <= 0), 0.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))), 6).alias("r2"))


def fowlkes_mallows(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labellings from their contingency counts: 1 below two rows, 0 without pairs on a side."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    tp = cells.agg(pairs("n").alias("tp"), F.sum("n").alias("rows"))
    left, right = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias(f"p_{c}")) for c in (a, b))
    got = tp.crossJoin(left).crossJoin(right)  # one row each
    bottom = F.sqrt(F.col(f"p_{a}") * F.col(f"p_{b}"))
    return got.select(F.round(F.when(F.col("rows") < 2, 1.0).when(bottom == 0, 0.0).otherwise(F.col("tp") / bottom), 6).alias("score"))


def cluster_separation(rows: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """Least gap between centroids over twice the mean of the clusters' mean radii."""
    table = materialize(centroids(rows, group, vector, dim), "centroids")
    radius = rows.join(small_side(table, 20_000), group).groupBy(group).agg(F.avg(F.sqrt(squared_distance(F.col(vector), F.col("centroid")))).alias("r")).agg(F.avg("r").alias("radius"))
    gaps = nearest(table, group, "centroid", table, group, other_than=group).agg(F.sqrt(F.min("d2")).alias("gap"))
    return gaps.crossJoin(radius).select(F.round(F.col("gap") / (F.col("radius") + 1e-8) / 2, 6).alias("separation"))  # one row each


def entropy(p: Column, k: Column) -> Column:
    """Normalised entropy of an array of probabilities over k choices; 0 for one choice."""
    h = F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return F.when(k <= 1, 0.0).otherwise(h / F.log(F.greatest(k, F.lit(2))))


def masked_softmax(logits: Column, legal: Column) -> Column:
    """Softmax over the first legal values; 0 for the others."""
    top = F.array_max(F.slice(logits, 1, legal))
    e = F.transform(logits, lambda x, i: F.when(i < legal, F.exp(x - top)).otherwise(0.0))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def pooled_difficulty(d: Column, beta: float = 8.0) -> Column:
    """Mean of difficulties weighted by exp(beta * d), as an aggregate over rows."""
    e = F.exp(beta * d)
    return F.sum(e * d) / F.greatest(F.sum(e), F.lit(1e-9))


def depth_for(difficulty: Column, exits: tuple[int, ...] = (3, 5, 8), low: float = TAU_LOW, high: float = TAU_HIGH) -> Column:
    return F.when(difficulty <= low, exits[0]).when(difficulty <= high, exits[1] if len(exits) > 1 else exits[-1]).otherwise(exits[-1])


def budget_depth(depth: Column, budget: Column, exits: tuple[int, ...] = (3, 5, 8)) -> Column:
    """The depth that a budget in (0, 1] allows: the deepest exit within it, and at most depth."""
    ceiling = F.greatest(F.lit(exits[0]), F.bround(budget * exits[-1]).cast("int"))
    allowed = F.array_max(F.filter(F.array(*[F.lit(e) for e in exits]), lambda e: e <= ceiling))
    return F.least(depth, allowed)


def duration_bounds(frames: Column, tempo: Column) -> tuple[Column, Column]:
    """Fewest and most frames for an estimate."""
    est = F.greatest(F.lit(1.0), frames / tempo).cast("int")
    high = F.greatest(F.lit(8), (est * 1.6).cast("int"))
    return F.least(F.greatest(F.lit(4), (est * 0.6).cast("int")), high), high


def learning_rate(step: Column, peak: float, warmup: int, total: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine to floor * peak."""
    t = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * t))))


def alignment_prior(frame: Column, frames: int, token: Column, tokens: int, strength: float = 1.0, width: float = 0.12) -> Column:
    """Log-bias that prefers the diagonal."""
    d = frame / max(1, frames - 1) - token / max(1, tokens - 1)
    return -strength * d * d / (2 * width * width)


def finite_mean(x: Column) -> Column:
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def guarded_correlation(x: str, y: str, least: float = 1e-6) -> Column:
    """Pearson correlation as an aggregate; 0 if either side hardly varies."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.coalesce(F.covar_pop(x, y) / F.nullif(F.when((sx > least) & (sy > least), sx * sy).otherwise(0.0), F.lit(0.0)), F.lit(0.0))


def standardize(rows: DataFrame, column: str, eps: float = 1e-6) -> DataFrame:
    stats = rows.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return rows.crossJoin(F.broadcast(stats)).withColumn("z", (F.col(column) - F.col("__m")) / (F.col("__s") + eps)).drop("__m", "__s")  # one row


def relabel_by_frequency(rows: DataFrame, label: str) -> DataFrame:
    """label, code, n: codes by falling frequency, the lower label first on ties."""
    per = rows.groupBy(label).agg(F.count("*").alias("n"))
    return per.select(label, (F.row_number().over(Window.orderBy(F.desc("n"), label)) - 1).alias("code"), "n")
