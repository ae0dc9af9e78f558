"""Toxicity with a convolutional text classifier over hashed word embeddings, trained in numpy.

A text is lower-cased and cut into words (letters and digits; marks end a word), each hashed to 32 bits by vectorised
polynomials over its bytes. Words of fewer than `least` training documents share one embedding of zeros, so what is learnt
is what several documents say. Filters of widths 1, 2 and 3 slide over the embeddings; as a filter is linear, its response is a
sum of table rows, one for each word under it. The maximum over the whole text, a ReLU and a logistic unit give the margin.

A table of log-frequencies of the same hashed words names a text's language (learnt from lang of the training part; what a
text is labelled with is no input). For every language with enough held-back training rows a threshold is calibrated on them, and
margins are shifted so that it stands at THRESHOLD; other languages take the threshold of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, slices
from .langid import held_out

#: Fixed value of the contract: a score of so much and more is predicted as toxic.
THRESHOLD = 0.3
WIDTHS = (1, 2, 3)
#: Positions whose responses are computed at once, and bytes that are cut into words at once.
POSITIONS, PART = 1 << 14, 1 << 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True
_PRIME = np.uint32(16777619)


def _word_bytes(b: np.ndarray) -> np.ndarray:
    """Which bytes of a lower-cased UTF-8 text belong to words. Latin-1 signs, general punctuation and CJK marks don't."""
    word = _WORD[b]
    signs = np.flatnonzero((b[:-1] == 0xC2) & (b[1:] < 0xC0))
    word[signs] = word[signs + 1] = False
    if len(b) > 2:
        marks = np.flatnonzero(((b[:-2] == 0xE2) & (b[1:-1] <= 0x81)) | ((b[:-2] == 0xE3) & (b[1:-1] == 0x80)))
        word[marks] = word[marks + 1] = word[marks + 2] = False
    return word


def _hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    word = _word_bytes(b)
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    edge = np.concatenate([[0] if word[0] else [], edge, [len(b)] if word[-1] else []]).astype(np.int64)
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint32)
    lengths = last - first
    power = np.cumprod(np.full(int(lengths.max()), _PRIME, np.uint32), dtype=np.uint32)
    chars = b[word].astype(np.uint32) + np.uint32(1)
    begin = lengths.cumsum() - lengths
    chars *= power[np.arange(len(chars)) - np.repeat(begin, lengths)]
    h = np.add.reduceat(chars, begin, dtype=np.uint32)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def word_hashes(text: str | None) -> np.ndarray:
    """A number below 2^32 for each word of a whole text, in order."""
    raw = (text or "").lower().encode()
    if len(raw) <= PART:
        return _hashes(raw) if raw else np.zeros(0, np.uint32)
    out, at = [], 0
    while at < len(raw):  # parts end at a space, so that no word is cut
        stop = raw.find(b" ", min(len(raw), at + PART)) + 1 or len(raw)
        out.append(_hashes(raw[at:stop]))
        at = stop
    return np.concatenate(out)


@dataclass
class Classifier:
    known: np.ndarray  # sorted hashes; the word known[i] has row i + 1 of the tables, all others row 0; the last row is that of gaps
    tables: list[np.ndarray]  # for each offset in a filter: [rows, filters of a width above the offset], widest filters first
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: float
    languages: list[str]
    language_table: np.ndarray  # [rows, languages]
    shifts: np.ndarray  # for each language, and last for any other: what is added to a margin

    def score(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts given as word hashes, and their languages' numbers."""
        words, at = _joined([_rows(self.known, d) for d in docs], len(self.known) + 1)
        pooled, _ = _pool(self.tables, words, at)
        margin = np.maximum(pooled + self.bias, 0) @ self.dense + self.dense_bias
        sums = np.add.reduceat(self.language_table[words], at, axis=0) if len(self.languages) else np.zeros((len(at), 0))
        language = np.where(np.ptp(sums, axis=1) > 0, sums.argmax(1), len(self.languages)) if len(self.languages) else np.zeros(len(at), int)
        return 1 / (1 + np.exp(-np.clip(margin + self.shifts[language], -30, 30))), language


def _rows(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at + 1, 0)


def _joined(docs: list[np.ndarray], gap_row: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, with gaps after each so that no filter reaches the next text; and where each begins. A text without words is one unknown word."""
    gap = np.full(max(WIDTHS) - 1, gap_row)
    docs = [d if len(d) else np.zeros(1, np.int64) for d in docs]
    at = np.cumsum([0] + [len(d) + len(gap) for d in docs])[:-1]
    return np.concatenate([x for d in docs for x in (d, gap)]), at


#: Response of a filter that begins in a gap: no text's maximum.
_NEVER = -1e6


def _pool(tables: list[np.ndarray], words: np.ndarray, at: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Maximum of each filter over each text's positions, and the places of the maxima if asked for."""
    n, filters = len(words), tables[0].shape[1]
    padded = np.concatenate([words, np.zeros(len(tables) - 1, np.int64)])
    best = np.full((len(at), filters), -np.inf, np.float32)
    where = np.zeros((len(at), filters), np.int64) if places else None
    for low in range(0, n, POSITIONS):
        high = min(n, low + POSITIONS)
        out = tables[0][padded[low:high]]
        for j in range(1, len(tables)):
            out[:, : tables[j].shape[1]] += tables[j][padded[low + j : high + j]]
        first = int(np.searchsorted(at, low, side="right")) - 1
        begins = np.concatenate([[low], at[first + 1 : np.searchsorted(at, high)]]).astype(np.int64) - low
        top = np.maximum.reduceat(out, begins, axis=0)
        docs = slice(first, first + len(begins))
        if places:
            for d, (a, b) in enumerate(zip(begins, [*begins[1:], high - low], strict=True)):
                here = out[a:b].argmax(0)
                where[first + d] = np.where(top[d] > best[first + d], low + a + here, where[first + d])
        best[docs] = np.maximum(best[docs], top)
    return best, where


def leanings(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different hashes of texts, how many texts hold each, and how surely each leans to a label.

    That is the log-odds of its texts' labels, as if both labels were as frequent, less two standard errors, and 0 where that changes the sign.
    """
    each = [np.unique(d) for d in docs]
    names, at = np.unique(np.concatenate(each) if each else np.zeros(0, np.uint32), return_inverse=True)
    label = np.repeat(np.asarray(y, np.int64), [len(x) for x in each])
    clean, toxic = (np.bincount(at[label == v], minlength=len(names)) for v in (0, 1))
    share = [len(y) / 2 / max(1, (y == v).sum()) for v in (0, 1)]
    odds = np.log((toxic * share[1] + 0.5) / (clean * share[0] + 0.5))
    doubt = 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return names, clean + toxic, (np.sign(odds) * np.maximum(0, np.abs(odds) - doubt)).astype(np.float32)


def fit_network(docs: list[np.ndarray], y: np.ndarray, lean: np.ndarray, *, dim: int = 8, filters: int = 8, epochs: int = 4, rate: float = 0.01, words_rate: float = 0.2, batch: int = 64, decay: float = 1e-3, seed: int = 5):
    """Adam on the logistic loss of texts (rows of the tables; lean has the leaning of each row). The maximum passes its gradient to one position of a filter.

    One coordinate of an embedding starts as the leaning, the others near 0. Embeddings move at words_rate of the other steps.
    """
    rng = np.random.default_rng(seed)
    total = filters * len(WIDTHS)
    embed = rng.normal(0, 0.01, (len(lean), dim)).astype(np.float32)
    embed[:, 0] = lean
    embed[0] = embed[-1] = 0
    convs = [rng.normal(0, 0.4, (dim, filters * sum(w > j for w in WIDTHS))).astype(np.float32) for j in range(max(WIDTHS))]
    dense, bias, out_bias = rng.normal(0, 0.3, total).astype(np.float32), np.zeros(total, np.float32), np.zeros(1, np.float32)
    params = [embed, *convs, dense, bias, out_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            words, at = _joined([docs[i] for i in rows], len(embed) - 1)
            used, own = np.unique(words, return_inverse=True)  # tables of the batch's words alone
            pooled, where = _pool(_tables(embed[used], convs), own, at, True)
            hidden = np.maximum(pooled + bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ dense + out_bias, -30, 30)))
            d = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = d[:, None] * dense * (hidden > 0)
            padded = np.concatenate([own, np.zeros(len(convs), np.int64)])
            g_embed, g_convs = np.zeros((len(used), dim), np.float32), []
            for j, c in enumerate(convs):
                hit = padded[where[:, : c.shape[1]] + j]
                part = np.zeros((len(used), c.shape[1]), np.float32)
                np.add.at(part, (hit, np.arange(c.shape[1])), back[:, : c.shape[1]])
                g_convs.append(embed[used].T @ part + decay * c)
                g_embed += part @ c.T
            t += 1
            lift = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            for k, (x, g) in enumerate(zip(params, [g_embed, *g_convs, hidden.T @ d + decay * dense, back.sum(0), d.sum(keepdims=True)], strict=True)):
                at_rows = used if k == 0 else slice(None)
                m, v = 0.9 * first[k][at_rows] + 0.1 * g, 0.99 * second[k][at_rows] + 0.01 * g * g
                first[k][at_rows], second[k][at_rows] = m, v
                x[at_rows] -= lift * (words_rate if k == 0 else 1) * m / (np.sqrt(v) + 1e-8)
            embed[0] = embed[-1] = 0
    return _tables(embed, convs), bias, dense, float(out_bias[0])


def _tables(embed: np.ndarray, convs: list[np.ndarray]) -> list[np.ndarray]:
    """The filters' responses to each row of embed; the last row is that of gaps."""
    tables = [embed @ c for c in convs]
    tables[0][-1] = _NEVER
    return tables


def _threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between margins among those where true positives' share less false positives' share is largest."""
    order = np.argsort(margin, kind="stable")
    m, hit = margin[order], y[order]
    hits, misses = hit.sum() - np.concatenate([[0], hit.cumsum()]), (1 - hit).sum() - np.concatenate([[0], (1 - hit).cumsum()])
    gain = hits / max(1, hit.sum()) - 3 * misses / max(1, (1 - hit).sum())  # a clean text that is flagged weighs three times
    bounds = np.concatenate([[m[0] - 2], m, [m[-1] + 2]])
    gap = bounds[1:] - bounds[:-1]
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    i = best[gap[best].argmax()]
    return float(bounds[i] + bounds[i + 1]) / 2


def fit(docs: list[np.ndarray], y: np.ndarray, lang: list[str | None], *, least: int = 4, least_positive: int = 12, **options) -> Classifier:
    """A classifier of texts (word hashes) with 0/1 labels. A fifth is held back to calibrate; without both labels every score is the prior's."""
    kept = first_of_copies(docs)
    docs, y, lang = [docs[i] for i in kept], np.asarray(y, np.float64)[kept], [lang[i] for i in kept]
    back = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~back)
    filters = options.get("filters", 8)
    known, n, lean = leanings([docs[i] for i in train], y[train])
    known, lean = known[n >= least], np.pad(lean[n >= least], 1)
    rows = [_rows(known, d) for d in docs]
    if 0 < y[train].sum() < len(train):
        tables, bias, dense, out_bias = fit_network([rows[i] for i in train], y[train], lean, **options)
    else:
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        tables = [np.zeros((len(lean), filters * sum(w > j for w in WIDTHS)), np.float32) for j in range(max(WIDTHS))]
        bias, dense, out_bias = np.zeros(filters * len(WIDTHS), np.float32), np.zeros(filters * len(WIDTHS), np.float32), float(np.log(p / (1 - p)))
    each = np.array([x or "" for x in lang], object)
    languages = sorted(x for x, n in zip(*np.unique(each.astype(str), return_counts=True), strict=True) if x and n >= 2 * least_positive) if len(each) else []
    counts = np.zeros((len(lean), len(languages)))
    for j, name in enumerate(languages):
        for i in np.flatnonzero(each == name):
            np.add.at(counts[:, j], np.unique(rows[i]), 1)
    table = np.log((counts + 0.5) / (counts.sum(0, keepdims=True) + 1))
    table = (table - table.mean(1, keepdims=True)).astype(np.float32) if len(languages) else table.astype(np.float32)
    table[[0, -1]] = 0
    goal = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    model = Classifier(known, tables, bias, dense, out_bias, languages, table, np.zeros(len(languages) + 1))
    held = np.flatnonzero(back)
    if 0 < y[train].sum() < len(train) and 0 < y[held].sum() < len(held):
        parts = [model.score([docs[i] for i in held[a : a + 256]]) for a in range(0, len(held), 256)]
        score, of = np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])
        margin = np.log(score / (1 - score))
        model.shifts[:] = goal - _threshold(margin, y[held])
        for j in range(len(languages)):
            own = of == j
            if y[held][own].sum() >= least_positive and (1 - y[held][own]).sum() >= least_positive:
                model.shifts[j] = goal - _threshold(margin[own], y[held][own])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_chars: int = 48 << 20) -> tuple[list[np.ndarray], np.ndarray, list[str | None]]:
    """Word hashes, 0/1 labels and languages of max_rows labelled documents of the training part at most, half of each label where there are so many.

    Taken are those whose ids hash lowest, until their texts hold max_chars together; longer ones are left out. Labels without an id, a
    value or a document don't count, several of one document count by their mean; of several texts under one id the least by hash counts.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    sized = source.where(~held_out()).groupBy("doc_id").agg(F.min(F.length("text")).alias("chars"))
    known = known.join(sized, "doc_id").where("chars > 0")
    halves = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(max_rows // 2).collect() for v in (1, 0)]  # at most max_rows small rows
    chosen, held = [], 0
    for k in range(max(map(len, halves))):
        for half in halves:
            if k < len(half) and held + half[k].chars <= max_chars:
                held += half[k].chars
                chosen.append((half[k].doc_id, half[k].y))
    if not chosen:
        return [], np.zeros(0), []
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, y int"))

    def run(batches):
        for part in slices(batches):
            words = [word_hashes(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), part.column("mark"), part.column("lang"), pa.array(words, pa.binary())], ["doc_id", "y", "mark", "lang", "words"])

    rows = source.join(picked, "doc_id").select("doc_id", "y", F.xxhash64("text").alias("mark"), "lang", "text").mapInArrow(run, "doc_id long, y int, mark long, lang string, words binary")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("mark", "words", "lang", "y")).alias("m")).select("doc_id", "m.*").toPandas()
    got = got.assign(k=[hash_order(i) for i in got.doc_id]).sort_values(["k", "doc_id"])
    return [np.frombuffer(w, np.uint32) for w in got.words], got.y.to_numpy(np.float64), [x if isinstance(x, str) else None for x in got["lang"]]


def first_of_copies(docs: list[np.ndarray]) -> list[int]:
    """The places of texts without those that follow a copy or a near copy, told by the three least hashes of their three-word windows.

    Copies would make the words of one text look like what many texts say.
    """
    seen, out = set(), []
    for i, d in enumerate(docs):
        w = d.astype(np.uint64)
        window = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:] * np.uint64(0x165667B19E3779F9)) if len(w) > 2 else w
        sign = np.unique((window ^ (window >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))[:3].tobytes()
        if sign not in seen:
            seen.add(sign)
            out.append(i)
    return out


def hash_order(doc_id: int) -> int:
    """A fixed order of ids in which labels and sources are mixed."""
    return (int(doc_id) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_chars: int = 48 << 20, **options) -> Classifier:
    return fit(*training_rows(docs, labels, max_rows, max_chars), **options)


def score_documents(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score, predicted and the language by words (null if none) of every document, over whole texts. A null text is scored as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.languages, None]
        for part in slices(batches):
            score, language = model.score([word_hashes(t) for t in part.column("text").to_pylist()]) if part.num_rows else (np.zeros(0), np.zeros(0, int))
            out = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array([names[i] for i in language], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out], ["doc_id", "score", "predicted", "words_lang"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int, words_lang string")
