"""The toxicity classifier: hashes and scores against plain loops, held-out accuracy on planted words, edge rows."""

import random
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import toxicity as T

BAD = {"en": ["grumbag", "snoot", "wretchling"], "xx": ["žluťák", "мразь", "bäh-bäh"]}
PLAIN = {"en": "ba de go ki lu", "xx": "žo ňu řa bü dö"}


def plain_hash(word):
    h, p = 0, 1
    for c in word.encode():
        p = p * 16777619 % 2**32
        h = (h + (c + 1) * p) % 2**32
    h ^= h >> 15
    h = h * 0x2C1B3C6D % 2**32
    return h ^ h >> 12


def make(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang, bad = rng.choice(["en", "xx"]), rng.random() < 0.3
        syllables = PLAIN[lang].split()
        words = ["".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(2, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]))
        text = " ".join(words)
        rows.append((i, text.upper() if rng.random() < 0.1 else text, lang, int(bad)))
    return rows


def test_word_hashes():
    for text in ("", "one", "Hello, WORLD… ‘quoted’ «ça»  x1", "中文。ok", " a b c", "é" * 3, "." * 5, " lead", "trail "):
        want = [plain_hash(w) for w in re.findall(r"[^\x00-\x2f:-@\[-`{-\x7f\u0080-¿ -ⁿ　-〿]+", text.lower())]
        assert T.word_hashes(text).tolist() == want
    assert T.word_hashes(None).tolist() == []
    long = "wort und noch ein wörtchen " * 90_000
    assert T.word_hashes(long).tolist() == [plain_hash(w) for w in long.split()[:5]] * 90_000


def test_score_against_plain_loops(monkeypatch):
    rows = make(300, 3)
    model = T.fit([T.word_hashes(r[1]) for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    monkeypatch.setattr(T, "POSITIONS", 50)  # texts run over several blocks
    place = {h: i + 1 for i, h in enumerate(model.known.tolist())}
    texts = [r[1] for r in make(40, 4)] + ["", "snoot", "!!"]
    got, langs = model.score([T.word_hashes(t) for t in texts])
    for text, score, lang in zip(texts, got, langs, strict=True):
        words = [place.get(h, 0) for h in T.word_hashes(text).tolist()] or [0]
        best = []
        for f in range(model.tables[0].shape[1]):
            at = [i for i, t in enumerate(model.tables) if f < t.shape[1]]
            padded = words + [0, 0]
            best.append(max(sum(model.tables[j][padded[i + j], f] for j in at) for i in range(len(words))))
        margin = sum(max(0, b + c) * d for b, c, d in zip(best, model.bias, model.dense, strict=True)) + model.dense_bias + model.shifts[lang]
        assert abs(score - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-4


def test_held_out_accuracy(spark):
    rows = make(2400, 5)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert model.languages == ["en", "xx"]
    got = {r.doc_id: r for r in T.score_documents(docs.withColumn("held", T.held_out()), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 400
    assert np.mean([got[r[0]].predicted == r[3] for r in held]) > 0.98
    assert np.mean([got[r[0]].words_lang == r[2] for r in held]) > 0.98
    assert all((r.score >= 0.3) == (r.predicted == 1) for r in got.values())
    # rows that may not be learnt from change nothing
    swapped = spark.createDataFrame([(r[0], 1 - r[3] if r in held else r[3]) for r in rows], "doc_id long, toxic int")
    again = T.train(docs, swapped)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True)) and np.array_equal(model.shifts, again.shifts)


def test_thresholds_by_language():
    """Where one language's margins lie higher, its own threshold stands between its labels."""
    assert T._threshold(np.array([-3.0, -2, -1, 4, 5]), np.array([0, 0, 0, 1, 1])) == 1.5
    assert T._threshold(np.array([2.0, 3, 8, 9]), np.array([0, 0, 1, 1])) == 5.5


def test_copies_count_once():
    text = " ".join(f"w{i}" for i in range(80))
    docs = [T.word_hashes(t) for t in (text, text, text + " more", "other words stand here", "")]
    assert T.first_of_copies(docs) in ([0, 3, 4], [0, 2, 3, 4])


@pytest.mark.parametrize("label", [None, 0, 1])
def test_one_label_or_none(spark, edge, empty, label):
    labels = spark.createDataFrame([(i, label) for i in (1, 3, 4, 5, None)] if label is not None else [], "doc_id long, toxic int")
    model = T.train(edge, labels)
    rows = T.score_documents(edge.withColumn("score", edge.n), model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows}) == 1
    assert T.score_documents(empty, model).count() == 0
    assert len(T.train(empty, labels).languages) == 0


def test_bounds_of_the_sample(spark):
    rows = make(400, 9)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows for _ in (0, 1)], "doc_id long, toxic int")
    words, y, _ = T.training_rows(docs, labels, max_rows=60)
    assert len(words) == 60 and y.sum() == 30
    words, _, _ = T.training_rows(docs, labels, max_chars=5000)
    assert 0 < sum(map(len, words)) < 5000
