"""Per-word clustering of vectors: projection, k-means, stability, and the gates that a split into codes has to pass.

A word's codes are fitted on at most cap of its vectors, in one task, in numpy; then every vector of the word takes the code of the
nearest centroid, those of frequent words in several tasks. Words run in parallel.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_side
from .manifest import capped
from .packing import apply_by_key, pack, rows_by_task

#: Rows of a word that one call labels.
ROWS_PER_GROUP = 4096


@dataclass(frozen=True)
class Clustering:
    min_word_freq: int = 5
    max_codes: int = 4
    n_bootstrap: int = 24
    bootstrap_frac: float = 0.8
    min_stability: float = 0.72
    min_silhouette: float = 0.10
    min_separation: float = 0.55
    max_duration_confound: float = 0.25
    pca_dim: int = 48
    min_cluster_frac: float = 0.12
    cap: int = 600
    seed: int = 1234


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)


def fit_projection(x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, float]:
    """mean, directions [k, d] and one scale for all; from the smaller of the Gram matrix and the singular values."""
    mean = x.mean(0)
    c = x - mean
    n, d = c.shape
    k = min(dim, d, max(1, n - 1))
    if n <= d:
        values, vectors = np.linalg.eigh(c @ c.T)
        top = np.argsort(-values)[:k]
        axes = (c.T @ vectors[:, top] / np.sqrt(np.maximum(values[top], 1e-12))).T
    else:
        axes = np.linalg.svd(c, full_matrices=False)[2][:k]
    spread = np.sqrt(((c @ axes.T) ** 2).sum(1).mean())
    return mean, axes, float(1 / (spread + 1e-8))


def whitened(x: np.ndarray, dim: int) -> np.ndarray:
    """Coordinates on the first principal components, each with unit variance."""
    c = x - x.mean(0)
    u, _, _ = np.linalg.svd(c, full_matrices=False)
    k = min(dim, u.shape[1])
    return u[:, :k] * np.sqrt(max(1, len(x) - 1))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, n_init: int = 6, max_iter: int = 120, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """labels, centroids and inertia of the best of n_init runs from spread-out starts; empty clusters restart at the worst point."""
    best = None
    for _ in range(n_init):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = squared_distances(x, centres).min(1)
            p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
            centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
        last = np.inf
        for _ in range(max_iter):
            d = squared_distances(x, centres)
            label = d.argmin(1)
            near = d[np.arange(len(x)), label]
            for j in range(k):
                centres[j] = x[label == j].mean(0) if (label == j).any() else x[near.argmax()]
            if np.isfinite(last) and abs(last - near.sum()) <= tol * max(abs(last), 1.0):
                break
            last = near.sum()
        label = squared_distances(x, centres).argmin(1)
        inertia = float(((x - centres[label]) ** 2).sum())
        if best is None or inertia < best[2]:
            best = label, centres.copy(), inertia
    return best


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance: 0 for members of clusters of one, and for less than two clusters."""
    names, code, size = np.unique(label, return_inverse=True, return_counts=True)
    if not 2 <= len(names) < len(x):
        return 0.0
    d = np.sqrt(squared_distances(x, x)) @ np.eye(len(names))[code]
    own = size[code]
    a = d[np.arange(len(x)), code] / np.maximum(own - 1, 1)
    d = d / size
    d[np.arange(len(x)), code] = np.inf
    b = d.min(1)
    s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
    return float(s.mean())


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Fowlkes-Mallows index."""
    if len(a) < 2:
        return 1.0
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda n: (n * (n - 1) / 2).sum()
    bottom = np.sqrt(pairs(table.sum(1)) * pairs(table.sum(0)))
    return float(pairs(table) / bottom) if bottom else 0.0


def confound(label: np.ndarray, seconds: np.ndarray) -> float:
    """Share of the variance of durations that lies between clusters."""
    total = ((seconds - seconds.mean()) ** 2).sum()
    if len(seconds) < 4 or total <= 0:
        return 0.0
    between = sum((label == k).sum() * (seconds[label == k].mean() - seconds.mean()) ** 2 for k in np.unique(label))
    return float(np.clip(between / total, 0, 1))


def separation(x: np.ndarray, label: np.ndarray, centres: np.ndarray) -> float:
    gaps = np.sqrt(squared_distances(centres, centres))[np.triu_indices(len(centres), 1)]
    radii = [np.linalg.norm(x[label == k] - centres[k], axis=1).mean() for k in range(len(centres)) if (label == k).any()]
    return float(gaps.min() / (np.mean(radii) + 1e-8) / 2)


def codes_of(x: np.ndarray, seconds: np.ndarray | None, p: Clustering, seed: int) -> tuple[np.ndarray, float, float, float, dict]:
    """labels by falling frequency, and stability, silhouette and separation of the split; one code if no split passes the gates.

    The last element is the model of the split, for nearest(): mean, axes, scale and centroids; empty for one code.
    """
    one = np.zeros(len(x), np.int64), 1.0, 0.0, 0.0, {}
    if len(x) < max(8, int(np.ceil(2 / p.min_cluster_frac))):
        return one
    rng = np.random.default_rng(seed)
    x = unit(x.astype(np.float64))
    mean, axes, scale = fit_projection(x, p.pca_dim)
    z, best = (x - mean) @ axes.T * scale, None
    for k in range(2, min(p.max_codes, len(x) // 2) + 1):
        label, centres, _ = kmeans(z, k, rng)
        size = np.bincount(label, minlength=k)
        if size.min() < p.min_cluster_frac * len(x):
            continue
        sil, sep = silhouette(z, label), separation(z, label, centres)
        if sil < p.min_silhouette or sep < p.min_separation or (seconds is not None and confound(label, seconds) > p.max_duration_confound):
            continue
        scores = []
        for _ in range(p.n_bootstrap):
            part = rng.choice(len(z), max(k + 1, int(p.bootstrap_frac * len(z))), replace=False)
            scores.append(agreement(kmeans(z[part], k, rng, n_init=2)[0], label[part]))
        stable = float(np.mean(scores)) if scores else 1.0
        if stable >= p.min_stability and (best is None or stable * sil * sep > best[0]):
            best = stable * sil * sep, label, centres, size, stable, sil, sep
    if best is None:
        return one
    _, label, centres, size, stable, sil, sep = best
    order = np.lexsort((np.arange(len(size)), -size))
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    return rank[label], stable, sil, sep, {"mean": mean, "axes": axes, "scale": scale, "centroids": centres[order]}


def nearest(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, scale: float, centroids: np.ndarray) -> np.ndarray:
    return squared_distances((unit(x.astype(np.float64)) - mean) @ axes.T * scale, centroids).argmin(1)


MODELS = "word string, n long, n_codes int, stability double, silhouette double, separation double, mean array<double>, axes array<array<double>>, scale double, centroids array<array<double>>"


def fit_codes(rows: DataFrame, params: Clustering = Clustering()) -> DataFrame:
    """One model for each word of rows: its number of rows n, n_codes, the split's quality, and what nearest() needs if n_codes > 1.

    Words with fewer than min_word_freq rows are left out; of more frequent ones at most params.cap rows count, drawn by hash. Words are
    dealt to tasks by what they cost, the dearest first.
    """
    frequent = materialize(rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= params.min_word_freq), "frequent")
    drawn = F.least(F.col("n"), F.lit(params.cap))
    cost = drawn * (drawn + 2000)  # distances of all pairs, and rounds over all rows
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = capped(rows, "word", "uid", params.cap).join(small_side(frequent, 200_000), "word")
    dealt = rows_by_task(held, "word", pack(frequent.select("word", cost.alias("cost")), "word", "cost", tasks), tasks)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        word = pdf.word.iloc[0]
        seconds = None if pdf.seconds.isna().any() else pdf.seconds.to_numpy()
        label, stable, sil, sep, m = codes_of(np.array(pdf.vector.tolist()), seconds, params, params.seed ^ zlib.crc32(str(word).encode()))
        model = [m["mean"], list(m["axes"]), m["scale"], list(m["centroids"])] if m else [None] * 4
        return pd.DataFrame([[word, pdf.n.iloc[0], label.max() + 1, stable, sil, sep, *model]], columns=["word", "n", "n_codes", "stability", "silhouette", "separation", "mean", "axes", "scale", "centroids"])

    return apply_by_key(dealt, "word", run, MODELS)


def discover_codes(rows: DataFrame, params: Clustering = Clustering()) -> DataFrame:
    """word, uid, code and the split's quality, of rows (word, uid, vector array<float>, seconds double or null).

    Codes are fitted on a sample of each word's rows and given to all of them. Words with fewer than min_word_freq rows are left out.
    """
    models = materialize(fit_codes(rows, params), "codes")
    rated = models.select("word", "n_codes", "stability", "silhouette", "separation")
    single = rows.join(small_side(rated.where("n_codes = 1").select("word"), 100_000), "word", "left_semi").select("word", "uid", F.lit(0).alias("code"))
    return assign_codes(rows, models.where("n_codes > 1")).unionByName(single).join(small_side(rated, 100_000), "word")


def assign_codes(rows: DataFrame, models: DataFrame) -> DataFrame:
    """word, uid, code of every row by the nearest of its word's centroids; models: word, n, mean, axes, scale, centroids (arrays).

    A word's rows are dealt to groups by n, its number of rows; each group gets the model once.
    """
    groups = F.ceil(F.col("n") / ROWS_PER_GROUP)
    dealt = rows.join(small_side(models.select("word", "n"), 100_000), "word").select("word", "uid", "vector", F.pmod(F.xxhash64("uid"), groups).alias("part"))
    copies = models.select("word", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("part"), "mean", "axes", "scale", "centroids")

    def run(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"word": [], "uid": [], "code": []})
        m = model.iloc[0]
        code = nearest(np.array(pdf.vector.tolist()), np.array(m["mean"]), np.stack(m["axes"]), m["scale"], np.stack(m["centroids"]))
        return pd.DataFrame({"word": pdf.word, "uid": pdf.uid, "code": code.astype("int32")})

    return dealt.groupBy("word", "part").cogroup(copies.groupBy("word", "part")).applyInPandas(run, "word string, uid long, code int")


def silhouette_blocks(n: int, block: int = 2048, most: int = 32_768, enough: int = 24) -> int:
    """Number of blocks of n rows. As each row is copied to every block, blocks grow once there are enough for the tasks, up to most rows."""
    return max(1, min(-(-n // block), enough), -(-n // most))


def exact_silhouette(rows: DataFrame, group: str, vector: str, uid: str, block: int = 2048) -> DataFrame:
    """Mean silhouette over all rows, from blocks of vectors against blocks: distances sum up by cluster, pairs are never rows.

    A task holds two blocks, and the distances of 256 rows at a time.
    """
    held = rows.select(F.col(uid).alias("uid"), F.col(group).alias("g"), F.col(vector).alias("v"))
    n = held.count()
    blocks = silhouette_blocks(n, block)
    held = held.withColumn("b", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    dealt = held.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("uid", "g", "v", F.col("b").alias("i"), F.col("i").alias("j"))
    both = dealt.withColumn("side", F.lit(0)).unionByName(dealt.select("uid", "g", "v", F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"uid": [], "g": [], "other": [], "total": [], "n": []})
        x, y = (np.array(side.v.tolist(), np.float64) for side in (a, b))
        names, code = np.unique(b.g, return_inverse=True)
        member, parts = np.eye(len(names))[code], []
        for k in range(0, len(x), 256):
            d = np.sqrt(squared_distances(x[k : k + 256], y))
            d[a.uid.to_numpy()[k : k + 256, None] == b.uid.to_numpy()[None]] = 0
            parts.append(d @ member)
        total = np.vstack(parts)
        return pd.DataFrame({"uid": np.repeat(a.uid.to_numpy(), len(names)), "g": np.repeat(a.g.to_numpy(), len(names)), "other": np.tile(names, len(a)), "total": total.ravel(), "n": np.tile(np.bincount(code), len(a))})

    sums = both.groupBy("i", "j").applyInPandas(run, "uid long, g int, other int, total double, n long").groupBy("uid", "g", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("g") == F.col("other"), F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1))))
    per = sums.groupBy("uid").agg(own.alias("a"), F.min(F.when(F.col("g") != F.col("other"), F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("silhouette"))
