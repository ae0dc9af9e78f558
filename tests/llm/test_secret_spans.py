"""All spans that op5 reports, the model's included, against a plain-Python reading of the rules and a plain Markov ratio."""

import hashlib
import random
import re

from corpusloom.llm import secrets

MODEL = [round(x, 4) for x in secrets.train(secrets.labelled_samples())]


def ratio(word):
    best = total = 0.0
    for a, b in zip(word, word[1:]):
        total = max(0.0, total + MODEL[(ord(a) - secrets.LOW) * secrets.SPAN + ord(b) - secrets.LOW])
        best = max(best, total)
    return best


def plain(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = [(m.start(), 3, m.end()) for m in re.finditer(secrets.CANDIDATE, text) if ratio(m[0]) > 10.0]
    more = [m for m in more if not any(b[0] <= m[0] and b[2] >= m[2] for b in base)]
    said = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [sum(b[1] == k for b in base) for k in range(3)] + [hashlib.sha256(said(base).encode()).hexdigest(), said(base + more), len(more)]


def texts(n=400):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda: "".join(rng.choices(letters, k=rng.randint(10, 44)))
    parts = [key, lambda: "AKIA" + key().upper(), lambda: hashlib.md5(key().encode()).hexdigest(), lambda: "database_connection_string=" + key(), lambda: "org/api/v1/" + key(), lambda: "password: " + key(),
             lambda: "Token='" + key()[:5] + "'", lambda: "several ordinary words", lambda: "an_identifier_of_some_length", lambda: "é中😀", lambda: "\n", lambda: "x" * 60, lambda: "=" * 30]
    return ["", None] + [rng.choice([" ", "", "; "]).join(rng.choice(parts)() for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_every_span(spark):
    rows = texts()
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    found = 0
    for i, text in enumerate(rows):
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans, r.n_markov] == plain(text), text
        found += r.n_markov
    assert found > 100


def test_spans_of_documents(spark, docs):
    some = docs.select("doc_id", "text")
    got = {r.doc_id: r.spans for r in secrets.scan(some).collect()}
    assert all(got[r.doc_id] == plain(r.text)[4] for r in some.collect())
