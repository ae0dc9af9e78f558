"""Manifest: reasons to skip rows, split assignment, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side


@dataclass(frozen=True)
class Limits:
    min_duration: float = 1.0
    max_duration: float = 20.0
    max_chars: int = 320
    max_words: int = 72


def skip_reason(path: Column, missing: Column, text: Column, duration: Column, n_words: Column, limits: Limits = Limits()) -> Column:
    """The first reason that holds, or null for rows to keep."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "no_path")
        .when(missing, "missing_audio")
        .when(F.coalesce(text, F.lit("")) == "", "empty_text")
        .when(F.length(text) > limits.max_chars, "too_long_text")
        .when(~duration.between(limits.min_duration, limits.max_duration), "duration")
        .when((n_words == 0) | (n_words > limits.max_words), "word_count")
    )


def skip_report(rows: DataFrame) -> DataFrame:
    return rows.where("skip_reason is not null").groupBy("skip_reason").agg(F.count("*").alias("n"))


def kept_fraction(rows: DataFrame, alarm: float = 0.9) -> DataFrame:
    """n, n_kept, kept, worst: the most frequent reason if less than alarm of all rows is kept."""
    per = rows.groupBy("skip_reason").agg(F.count("*").alias("c"))
    kept = F.coalesce(F.sum(F.when(F.col("skip_reason").isNull(), F.col("c"))), F.lit(0))
    worst = F.max(F.when(F.col("skip_reason").isNotNull(), F.struct("c", "skip_reason")))["skip_reason"]
    got = per.agg(F.sum("c").alias("n"), kept.alias("n_kept"), worst.alias("worst"))
    return got.select("n", "n_kept", F.round(F.col("n_kept") / F.col("n"), 6).alias("kept"), F.when(F.col("n_kept") / F.col("n") < alarm, F.col("worst")).alias("worst"))


def split_report(rows: DataFrame, seconds: str = "duration") -> DataFrame:
    """split, n, hours, with a TOTAL row."""
    got = rows.rollup("split").agg(F.count("*").alias("n"), F.round(F.sum(seconds) / 3600, 6).alias("hours"), F.grouping("split").alias("g"))
    return got.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("split")).alias("split"), "n", "hours")




def assign_splits(rows: DataFrame, uid: str, seed: str = "1234", dev: float = 0.04, test: float = 0.04) -> DataFrame:
    """rows with a split: exactly max(1, floor(share * n)) rows of dev and of test, the ones whose hashes come first.

    The cut hashes are found by counting hash prefixes and then ranking within one prefix, so rows are never sorted as a whole.
    Existing splits, in a column of that name, stay and don't count.
    """
    mark = F.md5(F.concat(F.lit(seed), F.col(uid).cast("string")))
    has = "split" in rows.columns
    rows = rows.withColumn("__h", mark).withColumn("__open", F.col("split").isNull() if has else F.lit(True))
    free = materialize(rows.where("__open").select("__h", F.col(uid).cast("string").alias("__u"), F.substring("__h", 1, 4).alias("p")), "splits")
    n = free.count()
    n_dev, n_test = max(1, int(dev * n)), max(1, int(test * n))
    counts = free.groupBy("p").agg(F.count("*").alias("c"))  # 65,536 prefixes at most
    before = counts.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "c")
    edges = before.where(" or ".join(f"(before < {k} and before + c >= {k})" for k in (n_dev, n_dev + n_test)))
    inside = free.join(small_side(edges, 10), "p").withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy("__h", "__u")) + F.col("before"))
    cuts = {k: inside.where(F.col("rank") == k).select("__h", "__u").first() for k in (n_dev, n_dev + n_test)}

    def upto(k: int) -> Column:
        cut = cuts[k]
        return F.lit(True) if cut is None else (F.col("__h") < cut[0]) | ((F.col("__h") == cut[0]) & (F.col(uid).cast("string") <= cut[1]))

    new = F.when(upto(n_dev), "dev").when(upto(n_dev + n_test), "test").otherwise("train")
    return rows.withColumn("split", F.when(F.col("__open"), new).otherwise(F.col("split")) if has else new).drop("__h", "__open")


def keep_splits(rows: DataFrame, split: str, empty: bool = True) -> DataFrame:
    """The rows of a split. Unless it may be empty, one row is looked for at once, and a ValueError names the splits that are there."""
    found = rows.where(F.col("split") == split)
    if not empty and found.limit(1).count() == 0:
        there = sorted(str(r.split) for r in rows.select("split").distinct().limit(20).collect())
        raise ValueError(f"no row of split {split!r}; there are {there}")
    return found


def capped(rows: DataFrame, key: str, uid: str, cap: int, seed: str = "1234") -> DataFrame:
    """At most cap rows of each key, those whose hashes come first: a sample that is the same in every run.

    Spark limits each key's rows before the shuffle (WindowGroupLimit) where cap is at most
    spark.sql.optimizer.windowGroupLimitThreshold, so the task of a hot key gets cap rows from each task before it.
    """
    order = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(seed), F.col(uid).cast("string"))), uid)
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= cap).drop("__k")


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in the order given, for a trial run; 0 takes all."""
    return rows.orderBy(*order).limit(n) if n else rows
