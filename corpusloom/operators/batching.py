"""Length buckets, batches, padding, ragged offsets, and moving values between words and characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side
from .intervals import points_in_intervals

#: Rows that one task ranks or sums up in order.
ROWS_PER_BIN = 100_000
#: Codes of characters that one Arrow batch holds.
CODES_PER_BATCH = 1 << 22
_PART = pa.struct([("size", pa.int32()), ("data", pa.binary())])
#: Stands for a null word number in runs.
_NONE = -(1 << 31)
BOUNDARIES = [32, 64, 96, 128, 160, 200, 240]


def bucket_of(length: Column, boundaries: list[int] = BOUNDARIES) -> Column:
    """Number of boundaries at or below a length."""
    return sum((F.when(length >= b, 1).otherwise(0) for b in boundaries), F.lit(0))


def batch_plan(rows: DataFrame, uid: str, length: str, batch: int, boundaries: list[int] = BOUNDARIES, seed: str = "1234", epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """uid, bucket, batch, slot: rows of a bucket in an order that the epoch's hash shuffles, cut into batches.

    Ranks run within (bucket, hash prefix) and start from the counts of the prefixes before, so no bucket is sorted in one task.
    The prefix is long enough for the number of rows: ROWS_PER_BIN of them share one, or fewer.
    """
    mark, digits = F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(uid).cast("string"))), 1
    bins = rows.count() // ROWS_PER_BIN
    while 16**digits < bins:
        digits += 1
    rows = rows.select(F.col(uid), bucket_of(F.col(length), boundaries).alias("bucket"), mark.alias("h")).withColumn("p", F.substring("h", 1, digits))
    counts = rows.groupBy("bucket", "p").agg(F.count("*").alias("c"))
    before = counts.select("bucket", "p", F.coalesce(F.sum("c").over(Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("bucket")).alias("size"))
    ranked = rows.join(before, ["bucket", "p"]).withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("bucket", "p").orderBy("h", uid)) - 1)
    if drop_last:
        ranked = ranked.where(F.col("k") < F.floor(F.col("size") / batch) * batch)
    return ranked.select(uid, "bucket", F.floor(F.col("k") / batch).alias("batch"), (F.col("k") % batch).alias("slot"))


def batch_counts(rows: DataFrame, length: str, batch: int, boundaries: list[int] = BOUNDARIES) -> DataFrame:
    per = rows.groupBy(bucket_of(F.col(length), boundaries).alias("bucket")).agg(F.count("*").alias("n"))
    return per.select("bucket", "n", F.ceil(F.col("n") / batch).alias("batches"), F.floor(F.col("n") / batch).alias("full_batches"))


def padding_waste(plan: DataFrame, lengths: DataFrame, uid: str, length: str) -> DataFrame:
    """Share of padded cells that hold no value."""
    per = plan.join(lengths.select(uid, length), uid).groupBy("bucket", "batch").agg(F.max(length).alias("m"), F.count("*").alias("n"), F.sum(length).alias("s"))
    cells = F.sum(F.col("m") * F.col("n"))
    return per.agg(cells.alias("cells"), F.round((cells - F.sum("s")) / cells, 6).alias("waste"))


def pad(values: Column, to: Column, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, (to - F.size(values)).cast("int")))


def ragged_offsets(rows: DataFrame, uid: str, length: str, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """uid, start, length of each row's values in one buffer ordered by uid: prefix sums in two levels, over bins and within.

    Bins are ranges of uid from Spark's range partitioning, so they are even however the uids lie; their number follows the rows.
    """
    rows = rows.select(F.col(uid), F.col(length).cast("long").alias("length"))
    bins = max(1, -(-rows.count() // rows_per_bin))
    rows = materialize(rows.repartitionByRange(bins, uid).withColumn("bin", F.spark_partition_id()), "offsets")
    sums = rows.groupBy("bin").agg(F.sum("length").alias("n"))  # a row for each bin
    before = sums.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bin").orderBy(uid).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("length").over(inside), F.lit(0))
    return rows.join(small_side(before, 1_000_000), "bin").select(uid, start.alias("start"), "length")


def words_to_chars(word_index: Column, values: Column, empty: Column) -> Column:
    """For each character the value of its word, or empty."""
    # the array around values has them computed once, not for each character
    own = lambda vs: F.transform(word_index, lambda w: F.when(w < 0, empty).otherwise(F.get(vs, w.cast("int"))))
    return F.get(F.transform(F.array(values), own), F.lit(0))


def chars_to_words(rows: DataFrame, uid: str, word: str, value: str, words: DataFrame | None = None) -> DataFrame:
    """Mean of the values of each word's characters. Of words (uid, word), where given, those without a character have the mean 0."""
    got = rows.where(F.col(word) >= 0).groupBy(uid, word).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    if words is None:
        return got
    return words.join(got, [uid, word], "left").select(uid, word, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def collate(rows: DataFrame, uid: str, values: str, plan: DataFrame, fill: int = 0) -> DataFrame:
    """uid, bucket, batch, padded values, mask: every array of a batch as long as its longest."""
    joined = rows.join(plan, uid)
    longest = joined.groupBy("bucket", "batch").agg(F.max(F.size(values)).alias("to"))
    got = joined.join(longest, ["bucket", "batch"])
    mask = F.concat(F.array_repeat(F.lit(1), F.size(values)), F.array_repeat(F.lit(0), (F.col("to") - F.size(values)).cast("int")))
    return got.select(uid, "bucket", "batch", pad(F.col(values), F.col("to"), F.lit(fill)).alias("padded"), mask.alias("mask"))


def ragged_slices(buffer: DataFrame, offsets: DataFrame, uid: str) -> DataFrame:
    """uid, values: each row's slice (uid, start, length) of a buffer (pos, value), in order. Raises if the buffer ends before a slice.

    Positions meet slices by an interval join, so the buffer is shuffled once however the slices lie and no position of a slice is made a
    row before it meets its value; a slice of length 0 is an empty array. Stores on disk are read by byte ranges: sources.ragged.
    """
    wanted = offsets.where("length > 0").select(uid, F.col("start").cast("long").alias("__low"), (F.col("start") + F.col("length")).cast("long").alias("__high"))
    met = points_in_intervals(buffer.select("pos", "value"), wanted, [], "pos", "__low", "__high")
    found = met.groupBy(uid).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))  # one slice
    found = found.select(F.col(uid), "n", F.transform("s", lambda x: x["value"]).alias("held"))
    kind = found.schema["held"].dataType
    short = F.raise_error(F.concat(F.lit("the buffer ends within the slice of "), F.col(uid).cast("string"))).cast(kind)
    values = F.when(F.col("length") <= 0, F.array().cast(kind)).when(F.coalesce("n", F.lit(0)) < F.col("length"), short).otherwise(F.col("held"))
    return offsets.select(uid, "length").join(found.hint("merge"), uid, "left").select(uid, values.alias("values"))


def _shrunk(*columns: np.ndarray) -> bytes:
    """Whole numbers of columns of one length, compressed: a sort holds what is moved, and sizes of partitions are sizes in memory."""
    return pa.compress(np.concatenate(columns).astype("<i4"), codec="zstd", asbytes=True)


def _grown(data: bytes, size: int, columns: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * size * columns, codec="zstd"), "<i4").reshape(columns, size)


def _steps(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether runs stand outside of words, and the step from one word to the next, which is small."""
    outside, steps = words < 0, words.copy()
    steps[~outside] = np.diff(words[~outside], prepend=0)
    return outside, steps


def _plan_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, part: rows (uid, idx, code) of a plan that stand together and have one uid, as one."""
    for b in batches:
        if len(b):
            uid, idx, none = b["uid"], b["idx"].to_numpy(zero_copy_only=False), b["code"].is_null().to_numpy(zero_copy_only=False)
            code = b["code"].fill_null(0).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, pc.not_equal(uid[1:], uid[:-1]).to_numpy(zero_copy_only=False)])
            ends = zip(first.tolist(), [*first[1:].tolist(), len(b)], strict=True)
            parts = [{"size": z - a, "data": _shrunk(np.diff(idx[a:z], prepend=0), code[a:z], none[a:z])} for a, z in ends]
            yield pa.RecordBatch.from_arrays([uid.take(pa.array(first)), pa.array(parts, _PART)], ["uid", "part"])


def _index_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, runs of rows (uid, word_index): the runs of one word number, which are fewer than characters."""
    for b in batches:
        index, runs = b["word_index"], []
        offsets, values = index.offsets.to_numpy(), index.values.fill_null(_NONE).to_numpy(zero_copy_only=False)
        for k, null in enumerate(index.is_null().to_pylist()):
            own = values[offsets[k] : offsets[k + 1]]
            first = np.flatnonzero(np.r_[np.ones(min(1, len(own)), bool), own[1:] != own[:-1]])
            runs.append(None if null else {"size": len(first), "data": _shrunk(*_steps(own[first]), np.diff(first, append=len(own)))})
        yield pa.RecordBatch.from_arrays([b["uid"], pa.array(runs, _PART)], ["uid", "runs"])


def _codes_of(runs: dict, parts: list[dict] | None, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of each character, and whether it is null."""
    outside, steps, lengths = _grown(runs["data"], runs["size"], 3)
    words = steps.copy()
    words[outside == 0] = np.cumsum(steps[outside == 0], dtype=np.int32)
    code, none = np.full(len(words), empty, np.int32), words == _NONE
    if parts:
        plan = np.concatenate([np.vstack([np.cumsum(p[0], dtype=np.int32)[None], p[1:]]) for p in (_grown(x["data"], x["size"], 3) for x in parts)], axis=1)
        plan = plan[:, np.argsort(plan[0], kind="stable")]
        at = np.minimum(np.searchsorted(plan[0], words), plan.shape[1] - 1)
        held = (plan[0][at] == words) & (words >= 0)
        code, none = np.where(held, plan[1][at], code), none | (held & (plan[2][at] == 1))
    return np.repeat(code, lengths), np.repeat(none, lengths)


def _coded(batches: Iterator[pa.RecordBatch], empty: int) -> Iterator[pa.RecordBatch]:
    """uid, codes of rows (uid, runs, parts), at most CODES_PER_BATCH codes, or one longer text, at a time."""

    def batch(uid: pa.Array, held: list) -> pa.RecordBatch:
        offsets = np.r_[0, np.cumsum([len(c) if c is not None else 0 for c, _ in held])].astype(np.int32)
        some = [h for h in held if h[0] is not None]
        values = pa.array(np.concatenate([c for c, _ in some]), pa.int32(), mask=np.concatenate([n for _, n in some])) if some else pa.array([], pa.int32())
        codes = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([c is None for c, _ in held]))
        return pa.RecordBatch.from_arrays([uid, codes], ["uid", "codes"])

    for b in batches:
        held, size, at = [], 0, 0
        for k in range(len(b)):
            runs = b["runs"][k].as_py()
            held.append((None, None) if runs is None else _codes_of(runs, b["parts"][k].as_py(), empty))
            size += 0 if runs is None else len(held[-1][0])
            if size >= CODES_PER_BATCH or k == len(b) - 1:
                yield batch(b["uid"][at : k + 1], held)
                held, size, at = [], 0, k + 1


def plan_char_codes(plan: DataFrame, indexed: DataFrame, empty: int) -> DataFrame:
    """uid, codes of rows (uid, word_index): for each character the code of its word if a plan (uid, idx, n_codes, code) gives it several, else empty.

    Words of the plan that stand together are one row before anything is grouped or sorted, and characters move as runs of one word:
    a row for each word made each task sort all words of its texts, and characters took four bytes each.
    """
    kind = indexed.schema["uid"].dataType.simpleString()
    own = plan.where("n_codes > 1 and uid is not null and idx is not null").select("uid", F.col("idx").cast("int"), F.col("code").cast("int"))
    parts = own.mapInArrow(_plan_parts, f"uid {own.schema['uid'].dataType.simpleString()}, part struct<size: int, data: binary>")
    parts = parts.groupBy("uid").agg(F.collect_list("part").alias("parts"))  # the words of one text
    runs = indexed.select("uid", F.col("word_index").cast("array<int>")).mapInArrow(_index_runs, f"uid {kind}, runs struct<size: int, data: binary>")
    # the plan may be exploded, so Spark takes codes for small: they would all go through the driver
    met = runs.join(parts.hint("merge"), "uid", "left").select(runs["uid"], "runs", "parts")
    return met.mapInArrow(lambda batches: _coded(batches, empty), f"uid {kind}, codes array<int>")
