"""Queries that SQL doesn't express, against plain Python over the whole smallest tables."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from corpusloom import queries as core
from corpusloom.functions.verbalize import verbalize
from corpusloom.operators import cluster, sequences

SF = "/root/testdata/sf0.001"


def rows(sql):
    return duckdb.connect().execute(sql.replace("@", SF)).fetchall()


def test_verbalize_text(spark):
    got = {r.doc_id: (r.spoken_md5, r.n) for r in core.all_queries()["verbalize_text"](spark, SF).collect()}
    for doc, text in rows("select doc_id, text from '@/documents.parquet'"):
        said = verbalize(text)
        assert got.pop(doc) == (hashlib.md5(said.encode()).hexdigest(), len(said))
    assert not got


def test_ctc_align(spark):
    got = {}
    for r in core.all_queries()["ctc_align"](spark, SF).collect():
        got.setdefault(r.uid, {})[r.i] = (r.start, r.end, r.score)
    for uid, label, vector in rows("select vec_id, label, embedding from '@/embeddings.parquet'"):
        want = sequences.viterbi(np.array(vector, np.float64).reshape(16, 4), [label % 3 + 1, 1, 2])
        own = got.pop(uid)
        assert [own[i][:2] for i in range(3)] == [w[:2] for w in want]
        assert np.allclose([own[i][2] for i in range(3)], [w[2] for w in want])
    assert not got


def test_monotonic_spans(spark):
    got = {r.doc_id: (r.n, r.n_kept) for r in core.all_queries()["monotonic_spans"](spark, SF).collect()}
    for doc, text in rows("select doc_id, text from '@/documents.parquet'"):
        last, kept, n = -1, 0, 0
        for m in re.finditer(r"[^\W_]+", text):
            n += 1
            start, end = m.start() + len(m[0]) % 3, m.end() + len(m[0]) % 4
            if start >= last:
                kept, last = kept + 1, end
        assert got.pop(doc) == (n, kept)
    assert not got


def test_embedding_projection(spark):
    got = {r.uid: r.coordinates for r in core.all_queries()["embedding_projection"](spark, SF).collect()}
    table = rows("select vec_id, embedding from '@/embeddings.parquet' order by vec_id")
    want = cluster.whitened(np.array([v for _, v in table], np.float64), 8)
    z = np.array([got[i] for i, _ in table])
    assert np.allclose(np.abs(z), np.abs(want), atol=1e-6) and len(got) == len(table)


def test_vowel_patterns(spark):
    """Of words of single letters with one short vowel each: the first letter carries none, the last none, articles none on their l."""
    got = core.all_queries()["vowel_patterns"](spark, SF).collect()
    assert len(got) == rows("select count(*) from '@/orders.parquet'")[0][0]
    for r in got:
        letters, vowels = r.word[::2], r.word[1::2]
        assert r.identity == letters.translate(str.maketrans("ةى", "هي"))
        want = []
        for i, (c, v) in enumerate(zip(letters, vowels, strict=True)):
            bare = i == 0 or (i == 1 and letters[:2] == "ال") or (letters[-1] in "ةه" and i >= len(letters) - 2)
            own = "" if bare or (c in "اوي" and v == "ْ") or v == "ّ" else v
            want.append(("+" if v == "ّ" and not bare else own) or "-")
        want[-1] = "-"  # the last letter's vowel is an ending, and it isn't doubled
        assert r.pattern.split("|") == want, r.word


def test_teacher_head_beats_chance(spark):
    got = core.all_queries()["teacher_head"](spark, SF).collect()
    held = dict(rows("select label, count(*) from '@/embeddings.parquet' where vec_id % 4 = 0 group by 1"))
    assert {r.label: r.n for r in got} == held
    assert all(0 <= r.accuracy <= 1 for r in got)


def test_discover_codes_covers_every_row(spark):
    got = core.all_queries()["discover_codes"](spark, SF).collect()
    want = {i: str(label % 5) for i, label in rows("select vec_id, label from '@/embeddings.parquet'")}
    assert {r.uid: r.word for r in got} == want
    for word in set(want.values()):
        own = [r for r in got if r.word == word]
        assert {r.n_codes for r in own} == {max(r.code for r in own) + 1}


@pytest.mark.parametrize("name", ["early_stop", "sampled_items"])
def test_now_in_sql(name):
    assert name in core.all_sql()
