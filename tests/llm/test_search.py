"""Ranked search against brute force over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """docs: (doc_id, text) rows, each a document; items: (item_id, text)."""
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_terms():
    for text in ("A b-C d_e 9fÉé 中文!\x00x", "", "...", "\U0001f600 ok ok", "`{|}~ @[]"):
        assert [t.decode() for t in search.terms(text.encode())] == words(text)
    assert search.terms(None) == []


def test_documents(spark, docs):
    some = docs.select("doc_id", "text").collect()
    items = [(i, " ".join((r.text or "").split()[:12])) for i, r in enumerate(some[::17])] + [(900, "the the the and"), (901, "nowhere-at-all zzzzq"), (902, None), (903, "")]
    want = brute([tuple(r) for r in some], items)
    assert rows(search.search(docs, frame(spark, items))) == want
    assert rows(search.search(docs.repartition(7), frame(spark, items), block_chars=60)) == want


def test_odd_tables(spark, edge, empty):
    items = [(1, "a b c h"), (2, "wort one"), (3, None), (None, "no id here"), (4, "x" * 60000), (5, "UNICODE ünïcödé 中文 text text"), (1, "a b c h")]
    want = brute([(r.doc_id, r.text) for r in edge.collect()], items)
    got = rows(search.search(edge.withColumn("item_id", edge.n), frame(spark, items)))
    assert got == want and [r for r in got if r[0] is None]
    assert rows(search.search(empty, frame(spark, items))) == []
    assert rows(search.search(edge, frame(spark, []))) == []


def test_one_id_for_most_rows(spark):
    docs = spark.range(9000).selectExpr("if(id % 3 > 0, 5, id) as doc_id", "concat('w', id % 50, ' common w', id % 7) as text")
    items = [(1, "w3 w4 w49"), (2, "common w6")]
    assert rows(search.search(docs, frame(spark, items))) == brute([tuple(r) for r in docs.collect()], items)


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 3)
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 5)
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": pa.array([0, 1, 1, 1, 2, 9, 10], pa.int64()), "win": pa.array([0, 0, 0, 0, 0, 1, 1], pa.int64()), "n": pa.array([4] * 7, pa.int64()),
         "terms": pa.array([[0], [1], [0, 1], [1], [0], [0, 1, 2, 3, 4, 5, 6], [2]], pa.list_(pa.int32())), "tfs": pa.array([[1], [1], [1, 2], [1], [1], [1] * 7, [3]], pa.list_(pa.int32()))}
    )
    got = [b.to_pylist()[0] for b in search._to_blocks([batch.slice(0, 2), batch.slice(2)])]
    assert [(b["win"], b["ids"]) for b in got] == [(0, [0, 1, 1]), (0, [1, 2]), (1, [9]), (1, [10])]
    assert got[0]["terms"] == [0, 1] and got[0]["counts"] == [2, 2] and got[0]["slots"] == [0, 2, 1, 2] and got[0]["tfs"] == [1, 1, 1, 2]


@pytest.mark.parametrize("seed", range(3))
def test_best_keeps_least_ids_of_equal_scores(seed):
    rng = np.random.default_rng(seed)
    all_rows = [(int(s), int(d)) for s, d in zip(rng.integers(1, 5, 200), rng.permutation(200), strict=True)]
    best = search._Best(1, 10)
    for a in range(0, 200, 25):
        best.offer(0, np.array([s for s, _ in all_rows[a : a + 25]]), [d for _, d in all_rows[a : a + 25]])
    assert sorted(((s, d) for s, _, d in best.heaps[0]), key=lambda x: (-x[0], x[1])) == sorted(all_rows, key=lambda x: (-x[0], x[1]))[:10]
