"""Ranked lexical search: postings of documents in fixed windows of doc_id, scored by scatter-adds and harvested into heaps.

Documents are cut into terms once, and only postings of terms that some item asks for are kept. They are dealt by window
(doc_id div WINDOW, so many ids each) and written as blocks: the documents of a window, and for each term the slots that hold it.
A window with more rows than slots (repeated ids) or very many postings makes several blocks; a document's score comes from
its own block alone, so a hot window can be split anywhere. For an item a block's term contributions are added into an array
with one place for each slot, which stays in the cache; a bitset says which slots were touched, so only those are read and
cleared. Each task keeps a heap of the best documents of each item over all its blocks; the heaps meet in one ranking.

Rows are documents: repeated rows are ranked each, and rows without an id come last among equal scores. Null and empty texts
have no terms: such documents count nowhere and such items find nothing. Each row of the items is an item of its own.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ._common import slices

#: Ids in a window, and places in the array that an item's scores are added up in.
WINDOW = 4096
#: A block is closed before it would hold more postings, unless one document alone does.
BLOCK_POSTINGS = 1 << 20

#: Fixed values of the contract: bytes that end a term become spaces, A-Z become a-z, all others stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return text.translate(_TABLE).split() if text else []


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, win, n (terms of the whole text), terms and tfs: the numbers of the vocabulary's terms in the document and how often they occur."""
    size = max(1, len(vocabulary))

    def run(batches):
        find = vocabulary.get
        for part in slices(batches):
            lengths, found, row = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                words = terms(text)
                lengths.append(len(words))
                known = [x for x in map(find, words) if x is not None]
                found += known
                row.append(len(known))
            key = np.repeat(np.arange(len(row)), row) * size + np.array(found, np.int64)
            key, tf = np.unique(key, return_counts=True)
            at = pa.array(np.searchsorted(key, np.arange(len(row) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (key % size, tf)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("win"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "win", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("win", F.shiftright("doc_id", WINDOW.bit_length() - 1))
    return rows.mapInArrow(run, "doc_id long, win long, n long, terms array<int>, tfs array<int>")


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row: the documents of a block and the postings of its terms, sorted by term."""
    ids = pa.concat_arrays([p.column("doc_id") for p in parts])
    n = np.concatenate([p.column("n").to_numpy() for p in parts])
    held = np.concatenate([p.column("terms").value_lengths().to_numpy() for p in parts])
    term, tf = (np.concatenate([_flat(p.column(c)) for p in parts]) for c in ("terms", "tfs"))
    order = np.argsort(term, kind="stable")
    slot = np.repeat(np.arange(len(n), dtype=np.int32), held)[order]
    term, counts = np.unique(term, return_counts=True)
    one = [[parts[0].column("win")[0].as_py()], [ids], [n], [term.astype(np.int32)], [counts.astype(np.int32)], [slot], [tf[order].astype(np.int32)], [int((n > 0).sum())], [int(n.sum())]]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x[0].to_pylist()] if isinstance(x[0], pa.Array) else x, k) for x, k in zip(one, kinds, strict=True)], _BLOCK_NAMES)


_BLOCK_NAMES = ["win", "ids", "lengths", "terms", "counts", "slots", "tfs", "n_docs", "n_terms"]


def _to_blocks(batches) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window in, blocks out: at most WINDOW documents of one window, and BLOCK_POSTINGS postings."""
    pending: list[pa.RecordBatch] = []
    win, rows, held = None, 0, 0
    for batch in batches:
        wins = batch.column("win").to_pylist()
        sizes = batch.column("terms").value_lengths().to_numpy()
        start = 0
        for i, (w, size) in enumerate(zip(wins, sizes, strict=True)):
            if rows and (w != win or rows == WINDOW or held + size > BLOCK_POSTINGS):
                pending.append(batch.slice(start, i - start))
                yield _block([p for p in pending if p.num_rows])
                pending, start, rows, held = [], i, 0, 0
            win, rows, held = w, rows + 1, held + int(size)
        pending.append(batch.slice(start))
    if rows:
        yield _block([p for p in pending if p.num_rows])


def blocks(rows: DataFrame) -> DataFrame:
    """The postings as one row for each block. Rebalancing by window lets Spark split a hot one and merge small ones."""
    kinds = "win long, ids array<long>, lengths array<long>, terms array<int>, counts array<int>, slots array<int>, tfs array<int>, n_docs long, n_terms long"
    return rows.hint("rebalance", F.col("win")).sortWithinPartitions("win", "doc_id").mapInArrow(_to_blocks, kinds)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Best:
    """The k best documents of each item: a heap of (score, -doc_id), the worst on top."""

    def __init__(self, items: int, k: int):
        self.heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # lower scores need not be looked at
        self.k = k

    def offer(self, item: int, scores: np.ndarray, ids: list) -> None:
        heap = self.heaps[item]
        for score, doc in zip(scores.tolist(), ids, strict=True):
            entry = (score, -(1 << 64) if doc is None else -doc, doc)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


def _score_block(row: dict, weights: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, best: _Best) -> None:
    term, counts, slots, tf = (row[c] for c in ("terms", "counts", "slots", "tfs"))
    m = 25 + (75 * row["lengths"] * n_docs) // max(1, n_terms)
    tf = tf.astype(np.int64)
    gain = np.repeat(weights[term], counts) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slots]))
    stop = counts.cumsum()
    where = np.full(len(weights), -1)
    where[term] = np.arange(len(term))
    size = len(row["ids"])
    total, marks = np.zeros(size, np.int64), {}

    def mark(t: int) -> np.ndarray:
        if t not in marks:
            bits = np.zeros(size, bool)
            bits[slots[stop[t] - counts[t] : stop[t]]] = True
            marks[t] = np.packbits(bits)
        return marks[t]

    for i, (wanted, times) in enumerate(items):
        at = where[wanted]
        held = at >= 0
        if not held.any():
            continue
        occupied = np.zeros(-(-size // 8), np.uint8)
        for t, q in zip(at[held].tolist(), times[held].tolist(), strict=True):
            a, b = stop[t] - counts[t], stop[t]
            total[slots[a:b]] += gain[a:b] if q == 1 else q * gain[a:b]
            occupied |= mark(t)
        touched = np.flatnonzero(np.unpackbits(occupied, count=size))
        scores = total[touched]
        total[touched] = 0
        good = np.flatnonzero(scores >= best.least[i])
        if len(good) > best.k:  # of many, those that can't be among the block's best need no heap
            good = good[scores[good] >= np.partition(scores[good], len(good) - best.k)[len(good) - best.k]]
        if len(good):
            best.offer(i, scores[good], [row["ids"][s] for s in touched[good].tolist()])


def _search(docs: DataFrame, items: list[tuple[int | None, bytes | None]], k: int) -> DataFrame:
    """The candidates of each task for items that fit the driver: item (place in the list), item_id, doc_id, score."""
    vocabulary: dict[bytes, int] = {}
    asked = []
    for _, text in items:
        each = Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(text))
        asked.append((np.array(list(each), np.int64), np.array(list(each.values()), np.int64)))
    index = materialize(blocks(postings(docs, vocabulary)), "postings")
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("df"))
    weights = np.zeros(max(1, len(vocabulary)), np.int64)
    for term, n in df.collect():  # a row for each term of these items at most
        weights[term] = weight(n_docs, n)
    names = [name for name, _ in items]

    def run(batches):
        best = _Best(len(asked), k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("ids", "lengths", "terms", "counts", "slots", "tfs")}
                row = {c: v.to_pylist() if c == "ids" else v.to_numpy() for c, v in row.items()}
                _score_block(row, weights, asked, n_docs, n_terms, best)
        rows = [(i, names[i], doc, score) for i, heap in enumerate(best.heaps) for score, _, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["item", "item_id", "doc_id", "score"])

    found = index.select("ids", "lengths", "terms", "counts", "slots", "tfs").mapInArrow(run, "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    Items are taken in blocks of about block_chars of text, as their terms are held by the driver and by each worker; every block
    goes through all documents. Items and documents are named by item_id and doc_id and read text; other columns are left out.
    """
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    chars = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    out = None
    for b in range(n):
        rows = wanted.where(F.col("block") == b).drop("block").collect()  # about block_chars
        part = _search(docs, [(r.item_id, bytes(r.text) if r.text is not None else None) for r in rows], k)
        out = part if out is None else out.unionByName(part)
    return out
