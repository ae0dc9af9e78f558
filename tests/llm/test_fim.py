"""Fill-in-middle against a plain reading of its rules, and the exact round trip."""

import hashlib
import re
from collections import Counter

import pytest

from corpusloom.llm import fim


def plain(doc_id, text, rate=90, spm_rate=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, text, len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, text, len(units), form, len(pre), len(mid), out


def check(rows, **rates):
    got = fim.transform(rows, **rates)
    want = Counter(plain(r.doc_id, r.text, **rates) for r in rows.select("doc_id", "text").collect())
    assert Counter(tuple(r) for r in got.collect()) == want
    back = got.select("text", fim.restore(got.output, got.form).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    return want


def test_documents(docs):
    forms = {row[3] for row in check(docs)}
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("rates", [{"rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100}, {"rate": 0}])
def test_rates(edge, rates):
    check(edge, **rates)


def test_odd_texts(spark, edge, empty):
    check(edge.withColumn("k", edge.n).withColumn("output", edge.n))
    assert fim.transform(empty).count() == 0
    long = ["ab1" * 200_000, "x" * 300_000, "\n\n" * 5000, "😀" * 3000 + "a" * 600 + "é", "a<P", "<<P", "b<S>c", "<", "Z" * 256 + "1", "1" * 256 + "Z", "é" * 255 + "abc" * 100]
    check(spark.createDataFrame([(i, t) for i in range(6) for t in long], "doc_id long, text string"), rate=100)


def test_one_row_repeated_and_one_id_for_all(spark):
    rows = spark.range(3000).selectExpr("7L as doc_id", "if(id % 2 = 0, 'same text again and again', concat('text ', id)) as text")
    check(rows)


def test_digests(docs):
    got = fim.digests(fim.transform(docs)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    assert all(r.output_sha256 == hashlib.sha256(plain(r.doc_id, texts[r.doc_id])[6].encode()).hexdigest() for r in got)
