"""Language identification with a byte convolutional network, trained in numpy.

A window of WINDOW bytes goes through filters of widths 2, 3 and 4 over one-hot bytes (so a filter is a table with a row of
weights for each byte), a maximum over the window's positions, a ReLU and a softmax. A document's score is the mean of its
windows' probabilities, weighted by the bytes each window holds; the windows cover the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side
from ._common import id_and_text, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]  # for offset j within a filter: [256, filters of a width above j]; the widest filters come first
    bias: np.ndarray  # [filters]
    dense: np.ndarray  # [filters, languages]
    dense_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum over positions of each filter's response, and where it is reached."""
        per = self.tables[0].shape[1] // len(WIDTHS)
        n = windows.shape[1] - max(WIDTHS) + 1
        out = self.tables[0][windows[:, :n]]
        for j in range(1, max(WIDTHS)):
            count = per * sum(w > j for w in WIDTHS)
            out[:, :, :count] += self.tables[j][windows[:, j : n + j]]
        where = out.argmax(1)
        return np.take_along_axis(out, where[:, None], 1)[:, 0], where

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(np.concatenate([self._max(windows[i : i + 32]) for i in range(0, len(windows), 32)]) + self.bias, 0)
        return _softmax(hidden @ self.dense + self.dense_bias)

    def _max(self, windows: np.ndarray) -> np.ndarray:
        per = self.tables[0].shape[1] // len(WIDTHS)
        n = windows.shape[1] - max(WIDTHS) + 1
        out = self.tables[0][windows[:, :n]]
        for j in range(1, max(WIDTHS)):
            out[:, :, : per * sum(w > j for w in WIDTHS)] += self.tables[j][windows[:, j : n + j]]
        return out.max(1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def to_windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, the last one padded with byte 0, and the bytes that each one holds."""
    n = max(1, -(-len(raw) // WINDOW))
    held = np.full(n, WINDOW)
    held[-1] = len(raw) - (n - 1) * WINDOW
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW), held


def fit(windows: np.ndarray, target: np.ndarray, langs: list[str], *, filters: int = 16, epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 7) -> Network:
    """Adam on the cross-entropy of windows. The maximum passes its gradient to one position of a filter, so a step touches few table rows."""
    rng = np.random.default_rng(seed)
    total = filters * len(WIDTHS)
    tables = [rng.normal(0, 0.1, (256, filters * sum(w > j for w in WIDTHS))).astype(np.float32) for j in range(max(WIDTHS))]
    net = Network(langs, tables, np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*net.tables, net.bias, net.dense, net.dense_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = len(target) / np.maximum(1, np.bincount(target, minlength=len(langs))) / len(langs)
    for _ in range(epochs):
        order = rng.permutation(len(target))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows], target[rows]
            top, where = net.pooled(x)
            hidden = np.maximum(top + net.bias, 0)
            d = _softmax(hidden @ net.dense + net.dense_bias)
            d[np.arange(len(y)), y] -= 1
            d *= (weight[y] / len(y))[:, None].astype(np.float32)
            back = (d @ net.dense.T) * (hidden > 0)
            grads = []
            for j, table in enumerate(net.tables):
                g, count = np.zeros_like(table), table.shape[1]
                hit = np.take_along_axis(x, where[:, :count] + j, 1)
                np.add.at(g, (hit, np.arange(count)), back[:, :count])
                grads.append(g)
            grads += [back.sum(0), hidden.T @ d, d.sum(0)]
            t += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def held_out(doc_id: str = "doc_id"):
    """Documents that training never sees: crc32 of the id as text, modulo 4, is 2. Without an id: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, per_lang: int = 800, per_doc: int = 4, max_docs: int = 50_000) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Labelled windows of at most per_lang different documents of each language, per_doc windows each, evenly spread.

    Every language with training text is learnt; where there are many, per_lang falls so that max_docs documents are taken in all,
    but one of each language at least. The documents are those of the training part whose ids and texts hash lowest, so the sample
    is bounded and the same in every run.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out())
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    total = counts.count()
    if not total:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    per_lang = max(1, min(per_lang, max_docs // total))
    mark = F.xxhash64("doc_id", "text", F.lit(11))
    share = (mark.cast("double") / float(1 << 63) + 1) / 2  # from 0 to 1
    # about twice as many as wanted and 20 more, so that hardly a language falls short; then exactly the lowest
    likely = small_side(counts.select(F.col("lang").alias("of_lang"), ((2 * per_lang + 20) / F.col("n")).alias("upto")), 100_000)
    near = known.join(likely, F.col("lang") == F.col("of_lang")).where(share <= F.col("upto")).select("lang", mark.alias("mark"))
    best = near.distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).where(F.col("k") <= per_lang)
    chosen = materialize(best.select(F.col("lang").alias("of_lang"), "mark"), "sample")
    step = F.greatest(F.lit(WINDOW), (F.length("text") / per_doc).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(per_doc - 1)), lambda i: F.substring("text", i * step + 1, F.lit(WINDOW)))
    got = known.withColumn("own", mark).join(small_side(chosen, 1_000_000), (F.col("lang") == F.col("of_lang")) & (F.col("own") == F.col("mark")), "left_semi")
    got = got.select("lang", "own", pieces.alias("pieces")).dropDuplicates(["lang", "own"])
    got = got.select("lang", "own", F.posexplode("pieces").alias("i", "piece")).where("length(piece) > 0").toPandas().sort_values(["own", "lang", "i"])
    langs = sorted(got.lang.unique())
    windows = [to_windows(p.encode())[0][:1] for p in got.piece]
    return np.concatenate(windows), got.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), langs


def train(docs: DataFrame, **bounds) -> Network | None:
    """A network from the training part of docs; None if no labelled text is there."""
    windows, target, langs = training_windows(docs, **bounds)
    return fit(windows, target, langs) if len(target) else None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every document. Texts that are null or hold no letter, and all without a network, are `und` with score 0."""

    def run(batches):
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
            if rows:
                each = [to_windows(texts[i].encode()) for i in rows]
                p = net.probabilities(np.concatenate([w for w, _ in each])) * np.concatenate([h for _, h in each])[:, None]
                starts = np.cumsum([0] + [len(h) for _, h in each])[:-1]
                p = np.add.reduceat(p, starts, axis=0) / np.array([h.sum() for _, h in each])[:, None]
                for i, row in zip(rows, p, strict=True):
                    best = int(row.argmax())
                    langs[i], scores[i] = net.langs[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
