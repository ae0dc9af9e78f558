"""Quality rules: word, line and repetition statistics of whole documents, base rules, and boosted trees over them.

The trees are gradient-boosted on the logistic loss from labelled documents, with histograms of quantile bins. Features in
MONOTONE may only lower the score as they rise: splits that would break this are refused, and the children's values are
bounded by the midpoint, so the whole tree is monotone. A fitted model is five flat numpy arrays, scored level by level
for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, slices

#: Fixed values of the contract.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "distinct", "line_words"]
#: -1: the score may only fall as the feature rises; 0: free.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": -1}

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 punctuation, of ASCII
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3


def _repeated(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    if len(ids) < 1 << 20:
        key = (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:]
    else:  # the product would overflow
        pair = np.unique(w[:-2] * len(ids) + w[1:-1], return_inverse=True)[1]
        key = pair * len(ids) + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text, and its FEATURES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # on exactly the six ASCII spaces
    n = len(words)
    chars = len(text) - sum(raw.count(bytes([c])) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = _repeated(words)
    upper, digits, marks = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=4)[1:4].tolist() if raw else (0, 0, 0)
    c, m = max(1, chars), max(1, n)
    features = [np.log1p(n), chars / m, symbols / c, dup / max(1, lines), repeats / m, upper / c, digits / c, marks / c, len(set(words)) / m, n / max(1, lines)]
    return [n, chars, symbols, dup, repeats], [float(x) for x in features]


@dataclass
class Trees:
    """Flat nodes: row < threshold goes left; a leaf points at itself. Its score is the sum of value over the trees' leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] < self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], *, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 8.0, ridge: float = 1.0) -> Trees:
    """Boost on rows x with 0/1 labels y. Without rows, or with one label only, every row gets that label's prior."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    p = (y.sum() + 1) / (len(y) + 2) if len(y) else 1 - 1e-3
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T] if len(y) else []
    binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], 1) if len(y) else None
    f = np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int, low: float, high: float) -> int:
        at = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        own = float(np.clip(gs / (hs + ridge), low, high))
        nodes.append([0, 0.0, at, at, own])
        best = (1e-6, -1, -1, 0.0, 0.0)
        for j, e in enumerate(edges) if left else ():
            gb, hb = (np.bincount(binned[rows, j], weights=v[rows], minlength=len(e) + 1).cumsum()[:-1] for v in (g, h))
            gl, hl, gr, hr = gb, hb, gs - gb, hs - hb
            a, b = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
            gain = gl * a - (hl + ridge) * a * a / 2 + gr * b - (hr + ridge) * b * b / 2 - (gs * own - (hs + ridge) * own * own / 2)
            gain[(hl * 4 < least) | (hr * 4 < least) | (monotone[j] * (b - a) < 0)] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], j, k, a[k], b[k])
        if best[1] >= 0:
            _, j, k, a, b = best
            goes, mid = binned[rows, j] <= k, (a + b) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[monotone[j]]
            nodes[at][:2] = [j, edges[j][k]]
            nodes[at][2] = grow(rows[goes], g, h, left - 1, *bounds[0])
            nodes[at][3] = grow(rows[~goes], g, h, left - 1, *bounds[1])
        return at

    for _ in range(trees if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-f))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth, -np.inf, np.inf))
        for node in nodes[first:]:
            node[4] *= rate
        part = _flat(nodes, roots[-1:], 0.0, depth)
        f += part.margin(x)
    return _flat(nodes, roots, base, depth)


def _flat(nodes: list, roots: list[int], base: float, depth: int) -> Trees:
    a = np.array(nodes, np.float64).reshape(-1, 5)
    return Trees(a[:, 0].astype(np.int64), a[:, 1].copy(), a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4].copy(), np.array(roots, np.int64), base, depth)


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of max_rows labelled documents at most, those whose ids hash lowest.

    Labels without an id, a value or a document are left out; several labels of a document count by their mean. Of different
    texts under one id the one that hashes lowest counts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    source = id_and_text(docs)
    known = known.join(source.select("doc_id"), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # the limit is the bound of the broadcast

    def run(batches):
        for part in slices(batches):
            rows = [statistics(t)[1] for t in part.column("text").to_pylist()]
            columns = [part.column("doc_id"), part.column("y"), part.column("mark"), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "mark", "x"])

    rows = source.withColumn("mark", F.xxhash64("text")).join(F.broadcast(known), "doc_id").select("doc_id", "y", "mark", "text")
    rows = rows.mapInArrow(run, "doc_id long, y int, mark long, x array<double>")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("mark", "x", "y")).alias("m")).select("doc_id", "m.x", "m.y").toPandas().sort_values("doc_id")
    x = np.array(got.x.tolist(), np.float64).reshape(-1, len(FEATURES))
    return x, got.y.to_numpy(np.float64)


def fit_labels(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, **options) -> Trees:
    x, y = training_rows(docs, labels, max_rows)
    return fit(x, y, [MONOTONE.get(f, 0) for f in FEATURES], **options)


def _run(model: Trees, threshold: float, extra: list[str]):
    def run(batches):
        for part in slices(batches):
            got = [statistics(t) for t in part.column("text").to_pylist()]
            stats = np.array([s for s, _ in got], np.int64).reshape(-1, 5)
            score = model.score(np.array([f for _, f in got], np.float64).reshape(-1, len(FEATURES)))
            failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > 50 * stats[:, 0])
            out = [pa.array(c) for c in stats.T] + [pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in extra), *out], [*extra, *_STATS, "base_failed", "kept", "score"])

    return run


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def score_documents(docs: DataFrame, model: Trees, threshold: float = 0.35) -> DataFrame:
    """Statistics, base_failed, kept and score of every document. A null text has no words and fails the base rules."""
    return id_and_text(docs).mapInArrow(_run(model, threshold, ["doc_id"]), f"doc_id long, {_OUT}")


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.35) -> DataFrame:
    """The rows of docs that the base rules and the model keep, with all their columns."""

    def run(batches):
        for part in slices(batches):
            got = [statistics(t) for t in part.column("text").to_pylist()]
            score = model.score(np.array([f for _, f in got], np.float64).reshape(-1, len(FEATURES)))
            keep = [s[0] >= MIN_WORDS and 100 * s[4] <= 50 * s[0] and v >= threshold for (s, _), v in zip(got, score, strict=True)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
