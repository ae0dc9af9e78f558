"""Points in intervals: intervals are dealt to bins, points join by bin, so the work follows the matches.

A point lies in one bin and an interval in those that it touches, so each pair meets once, in the point's bin. Keys with very
many points (one utterance of a million frames) are spread over their bins. The best width is near the intervals' length: an
interval then touches about two bins and a bin holds few points that lie outside of it. Longer intervals are copied once for
each bin, which their matches pay for wherever points are dense.

Joins here merge: sides are often made by explode(), whose size Spark takes for that of the rows before it, and it would broadcast
characters or intervals of a whole corpus through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_width(intervals: DataFrame, low: str, high: str) -> float:
    """The power of two at or above the mean length of the intervals that aren't empty; 1 if there are none."""
    mean = intervals.where(F.col(high) > F.col(low)).agg(F.avg((F.col(high) - F.col(low)).cast("double"))).first()[0]
    return 2.0 ** math.ceil(math.log2(mean)) if mean and math.isfinite(mean) else 1.0


def _bin(at: Column, width: float) -> Column:
    return F.floor(at.cast("double") / width).cast("long")


def _dealt(intervals: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Intervals that aren't empty, a row for each __bin that they touch."""
    first = _bin(F.col(low), width)
    # the last bin that holds something below high
    last = F.greatest(first, (F.ceil(F.col(high).cast("double") / width) - 1).cast("long"))
    return intervals.where(F.col(high) > F.col(low)).withColumn("__bin", F.explode(F.sequence(first, last)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """The columns of both sides for each point and interval of the same keys with low <= at < high. Nulls match nothing.

    Apart from the keys, of which there may be none, the two sides must not share names. Without a width it is chosen by one aggregate over the intervals.
    """
    clash = (set(points.columns) & set(intervals.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    width = width or bin_width(intervals, low, high)
    held = _dealt(intervals, low, high, width)
    met = points.withColumn("__bin", _bin(F.col(at), width)).join(held.hint("merge"), [*keys, "__bin"])
    return met.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bin")


def char_words(characters: DataFrame, spans: DataFrame, uid: str = "uid") -> DataFrame:
    """uid, pos, word_index of characters (uid, pos), each given once: the word of spans (uid, word_index, start, end) that it stands in, the first if
    there are several, -1 outside of words.

    A left join by bin keeps characters outside of words, and its rows stay dealt by (uid, bin): characters are shuffled once.
    """
    width = bin_width(spans, "start", "end")
    held = _dealt(spans.select(F.col(uid).alias("__uid"), "word_index", "start", "end"), "start", "end", width).withColumnRenamed("__bin", "__held")
    here = (F.col(uid) == F.col("__uid")) & (F.col("__bin") == F.col("__held")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    met = characters.select(uid, "pos", _bin(F.col("pos"), width).alias("__bin")).join(held.hint("merge"), here, "left")
    owner = met.groupBy(uid, "__bin", "pos").agg(F.min("word_index").alias("word_index"))
    return owner.select(uid, "pos", F.coalesce("word_index", F.lit(-1)).alias("word_index"))
