"""Principal components of a whole table of vectors: partitions send their count, mean and scatter matrix, which merge exactly.

A partition's share is [d] and [d, d] numbers however many vectors it holds. Shares merge in groups of FAN, level by level, so no
task and not the driver holds more than FAN of them; the last one is the table's. Merging centred shares keeps the digits that
sums of squares would lose where means are large.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

FAN = 32
_SHARE = "part long, n long, mean array<double>, scatter array<double>"


def merge(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and scatter of two sets of vectors together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _row(part: int, share: tuple[int, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    lists = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in share[1:]]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([share[0]], pa.int64()), *lists], ["part", "n", "mean", "scatter"])


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    scatter: np.ndarray  # sum of outer products of what vectors differ from the mean


def moments(rows: DataFrame, vector: str, dim: int) -> Moments:
    """Of all vectors that are not null and have dim values without a null; others raise an error."""
    from pyspark import TaskContext

    def share(batches):
        total = (0, np.zeros(dim), np.zeros((dim, dim)))
        for b in batches:
            held = b.column(0)
            if len(held) == 0:
                continue
            lengths = np.asarray(held.value_lengths())
            if (lengths != dim).any() or held.flatten().null_count:
                raise ValueError(f"vectors must have {dim} values without nulls")
            x = np.asarray(held.flatten(), np.float64).reshape(-1, dim)
            mean = x.mean(0)
            total = merge(total, (len(x), mean, (x - mean).T @ (x - mean)))
        yield _row(TaskContext.get().partitionId(), total)

    def together(batches):
        part, total = None, (0, np.zeros(dim), np.zeros((dim, dim)))
        for b in batches:
            for i in range(b.num_rows):
                key = b.column(0)[i].as_py() // FAN
                if part is not None and key != part:
                    yield _row(part, total)
                    total = (0, np.zeros(dim), np.zeros((dim, dim)))
                part = key
                total = merge(total, (b.column(1)[i].as_py(), b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy().reshape(dim, dim)))
        if part is not None:
            yield _row(part, total)

    shares = materialize(rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(share, _SHARE), "shares")
    count = shares.agg(F.max("part")).first()[0]
    while count:  # parts are numbered from 0, and each level leaves one for every FAN of them
        dealt = shares.repartition(max(1, (count + FAN) // FAN), F.floor(F.col("part") / FAN)).sortWithinPartitions("part")
        shares = materialize(dealt.mapInArrow(together, _SHARE), "shares")
        count //= FAN
    last = shares.first()
    if last is None or not last.n:
        return Moments(0, np.zeros(dim), np.zeros((dim, dim)))
    return Moments(last.n, np.array(last["mean"]), np.array(last.scatter).reshape(dim, dim))


@dataclass(frozen=True)
class Projection:
    mean: np.ndarray
    axes: np.ndarray  # [k, d], orthonormal, by falling variance
    scale: np.ndarray  # [k]: one number for all, or one for each if whitened
    variance: np.ndarray  # of each axis, over n - 1


def fit(rows: DataFrame, vector: str, dim: int, k: int, whiten: bool = False) -> Projection:
    """The first k principal axes of all vectors, at most n - 1 of them (1 at least). An axis points to where its largest component is positive.

    Coordinates are scaled by one number, so that their mean square length is 1, or if whitened each to unit variance.
    """
    m = moments(rows, vector, dim)
    k = min(k, dim, max(1, m.n - 1))
    values, vectors = np.linalg.eigh(m.scatter)
    top = np.argsort(-values, kind="stable")[:k]
    axes = vectors[:, top].T
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    held = np.maximum(values[top], 0)
    variance = held / max(1, m.n - 1)
    scale = 1 / np.maximum(np.sqrt(variance), 1e-12) if whiten else np.full(k, 1 / (np.sqrt(held.sum() / max(1, m.n)) + 1e-8))
    return Projection(m.mean, axes, scale, variance)


def project(rows: DataFrame, uid: str, vector: str, p: Projection) -> DataFrame:
    """uid, coordinates of every row; null for null vectors."""

    def run(batches):
        for b in batches:
            held = b.column(1)
            x = np.asarray(held.flatten(), np.float64).reshape(-1, len(p.mean))
            z = (x - p.mean) @ p.axes.T * p.scale
            ends = np.concatenate([[0], np.asarray(held.is_valid()).cumsum()]) * z.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(z.ravel()), mask=held.is_null())
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["uid", "coordinates"])

    kind = rows.schema[uid].dataType.simpleString()
    return rows.select(F.col(uid).alias("uid"), F.col(vector).cast("array<double>")).mapInArrow(run, f"uid {kind}, coordinates array<double>")
