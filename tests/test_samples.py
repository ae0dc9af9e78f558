"""Assembly and collation of samples against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chars, vocab
from corpusloom.operators import batching, samples

TEXTS = {1: "the lead is on", 2: "a", 3: "lead rose, lead", 4: "", 5: None, 6: "no one here at all", 7: "rose"}
CODES = {"lead": 2, "rose": 3, "on": 1}
LABELS = {(1, 1): 1, (3, 0): 0, (3, 1): 2, (6, 0): 1}
IDS = {c: i + 5 for i, c in enumerate("abcdefghilnorst")} | {" ": 4}


def plain(uid, frames, vectors, variants, dim):
    text = TEXTS[uid] or ""
    words, index = [], []
    for i, c in enumerate(text):
        inside = c.isalpha()
        if inside and (i == 0 or not text[i - 1].isalpha()):
            words.append("")
        if inside:
            words[-1] += c
        index.append(len(words) - 1 if inside else -1)
    n = [CODES.get(w, 1) for w in words]
    v = variants.get(uid)
    teacher = vectors.get(uid)
    if teacher is not None:
        teacher = (teacher + [[0.0] * dim] * len(words))[: len(words)]
    return {
        "char_ids": [1] + [IDS.get(c, 3) for c in text] + [2], "word_index": [-1, *index, -1], "n_codes": n, "code_target": [LABELS.get((uid, i), -1) if k > 1 else -1 for i, k in enumerate(n)],
        "n_words": len(words), "variants": [0, *(v if v is not None and len(v) == len(text) else [0] * len(text)), 0], "codes": frames.get(uid), "teacher": teacher,
    }


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    frames = {u: rng.integers(0, 9, (int(rng.integers(1, 6)), 2)).tolist() for u in TEXTS if u != 6}
    vectors = {1: [[1.0, 2.0]] * 6, 3: [[3.0, 4.0]], 2: [[5.0, 6.0]]}
    variants = {1: [i % 3 for i in range(14)], 2: [1, 1], 7: [9, 0, 0, 2]}
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    tables = {
        "rows": frame(list(TEXTS.items()), "uid int, text string"), "ids": spark.range(1).select(F.create_map(*[F.lit(x) for p in IDS.items() for x in p]).alias("ids")),
        "lexicon": frame(list(CODES.items()), "word string, n_codes int"), "labels": frame([(*k, v) for k, v in LABELS.items()], "uid int, pos int, code int"),
        "variants": frame(list(variants.items()), "uid int, variants array<int>"), "codes": frame(list(frames.items()), "uid int, codes array<array<int>>"), "teacher": frame(list(vectors.items()), "uid int, vectors array<array<double>>"),
    }
    return tables, {u: plain(u, frames, vectors, variants, 2) for u in TEXTS if u in frames}


def test_assemble(made):
    tables, want = made
    got = {r.uid: r.asDict(True) for r in samples.assemble(**tables, teacher_dim=2, identity=chars.fold_latin).collect()}
    assert sorted(got) == sorted(want)
    for uid, row in want.items():
        assert {k: got[uid][k] for k in row} == row, uid
    bare = {r.uid: r for r in samples.assemble(tables["rows"], tables["ids"]).collect()}
    assert len(bare) == 7 and bare[1].n_codes == [1] * 4 and bare[1].code_target == [-1] * 4 and bare[5].char_ids == [1, 2] and "codes" not in bare[1].asDict()


def test_collate(spark, made):
    tables, want = made
    rows = samples.assemble(**tables, teacher_dim=2, identity=chars.fold_latin)
    plan = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 1), (4, 0, 1), (5, 1, 0), (7, 0, 0)], "uid int, bucket int, batch int")
    got = {r.uid: r.asDict(True) for r in samples.collate(rows, plan, 0, 4, 2, 2).collect()}
    for group in ([1, 2, 7], [3, 4], [5]):
        length, words, frames = (max(len(want[u][c]) for u in group) for c in ("char_ids", "n_codes", "codes"))
        for u in group:
            s, g = want[u], got[u]
            pad = lambda values, to, fill: values + [fill] * (to - len(values))
            assert g["char_ids"] == pad(s["char_ids"], length, 0) and g["word_index"] == pad(s["word_index"], length, -1)
            assert g["char_padding"] == pad([False] * len(s["char_ids"]), length, True) and g["variants"] == pad(s["variants"], length, 0)
            assert g["n_codes"] == pad(s["n_codes"], words, 0) and g["code_target"] == pad(s["code_target"], words, -1)
            assert g["word_mask"] == pad([True] * s["n_words"], words, False)
            own = [s["code_target"][w] if w >= 0 and s["n_codes"][w] > 1 and s["code_target"][w] >= 0 else 4 for w in s["word_index"]]
            assert g["char_codes"] == pad(own, length, 4)
            assert g["codes"] == pad(s["codes"], frames, [0, 0]) and g["frame_mask"] == pad([True] * len(s["codes"]), frames, False) and g["n_frames"] == len(s["codes"])
            assert g["teacher"] == pad(s["teacher"] or [], words, [0.0, 0.0])


def test_documents_in_batches(spark):
    """Whole documents, planned by length: batches are rectangular, and what stands under the masks is what was assembled."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("uid"), "text")
    ids = vocab.as_map(vocab.char_vocab(docs.select("text")))
    lexicon = docs.select(F.explode(chars.words(F.col("text"))).alias("w")).select(chars.fold_latin(F.col("w")).alias("word")).distinct().withColumn("n_codes", F.length("word") % 3 + 1)
    rows = samples.assemble(docs, ids, lexicon, identity=chars.fold_latin)
    plan = batching.batch_plan(docs.withColumn("len", F.length("text")), "uid", "len", 16)
    got = samples.collate(rows, plan)
    per = got.groupBy("bucket", "batch").agg(F.count("*").alias("n"), *[F.countDistinct(F.size(c)).alias(c) for c in ("char_ids", "word_index", "char_codes", "variants", "n_codes", "word_mask")])
    assert all(r.n <= 16 and set(r[3:]) == {1} for r in per.collect())
    total = got.select(F.explode("n_codes").alias("x")).where("x > 0").agg(F.sum("x")).first()[0]
    assert total == rows.select(F.explode("n_codes").alias("x")).agg(F.sum("x")).first()[0]
