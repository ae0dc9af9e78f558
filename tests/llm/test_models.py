"""op2, op7 and op5's model: held-out accuracy, monotonic trees, brute force."""

import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import langid, quality, secrets

SF = "/root/testdata/sf0.01"


def test_language(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.train(docs, per_lang=150)
    got = langid.predict(docs, net).join(docs.select("doc_id", "lang", langid.held_out().alias("held")), "doc_id").where("held").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    rows = langid.predict(edge, net).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 6)} == {"und"}
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0
    assert {r.lang_pred for r in langid.predict(edge, None).collect()} == {"und"}


def test_training_never_sees_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marked = docs.withColumn("text", F.when(langid.held_out(), F.lit("held out")).otherwise(F.col("text")))
    windows, _, _ = langid.training_windows(marked, per_lang=10**6)
    assert not any(bytes(w).startswith(b"held out") for w in windows)


def plain_probabilities(net, raw):
    """A window's probabilities by plain loops over filters and places."""
    per, hidden = net.tables[0].shape[1] // len(langid.WIDTHS), []
    for f in range(net.tables[0].shape[1]):
        width = sorted(langid.WIDTHS, reverse=True)[f // per]
        hidden.append(max(0.0, max(sum(float(net.tables[j][raw[at + j], f]) for j in range(width)) for at in range(len(raw) - max(langid.WIDTHS) + 1)) + float(net.bias[f])))
    z = np.array(hidden) @ net.dense + net.dense_bias
    e = np.exp(z - z.max())
    return e / e.sum()


def test_prediction_by_plain_loops(spark, docs):
    net = langid.train(docs, per_lang=30)
    rows = docs.orderBy("n_chars").limit(6)
    got = {r.doc_id: r for r in langid.predict(rows, net).collect()}
    for r in rows.collect():
        raw = r.text.encode()
        parts = [raw[a : a + langid.WINDOW] for a in range(0, len(raw), langid.WINDOW)]
        p = sum(plain_probabilities(net, x.ljust(langid.WINDOW, b"\0")) * len(x) for x in parts) / len(raw)
        assert got[r.doc_id].lang_pred == net.langs[int(p.argmax())] and abs(got[r.doc_id].score - p.max()) < 1e-4


def test_every_language_is_learnt(spark):
    rows = [(i, f"text {i} of language {i % 90} " * 3, f"l{i % 90:02d}") for i in range(2000)] + [(5000, "same text again", "hot")] * 500 + [(5000 + i, f"other {i}", "hot") for i in range(1, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, target, langs = langid.training_windows(df, per_lang=5, per_doc=1)
    assert langs == sorted({r[2] for r in rows}) and np.bincount(target).max() == 5 and np.bincount(target).min() > 0
    _, target, langs = langid.training_windows(df, per_lang=5, per_doc=1, max_docs=95)
    assert len(langs) == 91 and np.bincount(target).max() == 1
    first, second = (langid.training_windows(df.repartition(n), per_lang=5)[0] for n in (3, 5))
    assert (first == second).all()


def test_trees_are_monotone():
    rng = np.random.default_rng(2)
    x = rng.random((600, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(600) < 0.1)).astype(float)
    model = quality.fit(x, y, [-1, 0], trees=30)
    grid = np.linspace(-0.5, 1.5, 101)
    for b in (0.1, 0.5, 0.9):
        assert (np.diff(model.margin(np.column_stack([grid, np.full(101, b)]))) <= 1e-12).all()
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.85
    assert (quality.fit(np.zeros((0, 2)), np.zeros(0), [0, 0]).score(x) > 0.9).all()


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else set(range(len(words)))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_quality(spark, edge, empty, docs):
    for text in [None, "", "a b c a b c a b", "x\nx\n\ny\r\ny\r", "a b c d " * 9, "é b c é b c #$", "wort " * 6000, *[r.text for r in docs.limit(40).collect()]]:
        assert quality.statistics(text)[0] == brute_statistics(text), text
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit_labels(docs, labels)
    rows = quality.score_documents(edge, model).collect()
    assert len(rows) == edge.count() and not any(r.kept and r.base_failed for r in rows)
    assert all(r.base_failed for r in rows)
    assert quality.score_documents(empty, model).count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == quality.score_documents(docs, model).where("kept").count()
    assert quality.fit_labels(docs, labels.limit(0)).score(np.zeros((1, 10)))[0] > 0.5


def test_training_rows_of_repeated_and_absent_ids(spark):
    texts = [(1, "a b c"), (1, "d e f g"), (2, "h i"), (2, "h i"), (None, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 2000)] + [(None, 1), (2, None)], "doc_id long, quality int")
    got = [quality.training_rows(docs.repartition(n), labels, max_rows=2) for n in (1, 4)]
    assert all((a == b).all() for a, b in zip(*got, strict=True)) and got[0][1].tolist() == [1, 0]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TRICKY = [
    "passwd: token: abcdefgh", "TOKEN = 'abc123def' password=x secret : \"0123456789abcdef0123456789abcdef\"", "AKIAAKIA" + "A" * 12 + " AKIA" + "Z" * 15, "😀 api_key=é apikey='zzzzzz' 😀",
    "f" * 23 + "g" + "f" * 24, "token=api_key=abcdef123", "the_user_name_of_the_request_handler and internationalization", "key Zx9Qw3Er5Ty7Ui1Op0As2Df4Gh6Jk8Lz", "",
]


def test_secrets(spark, edge, empty):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    for i, t in rows:
        base = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i].spans.split(",")) | {""} and got[i].n_assign == sum(b.startswith("assign") for b in base)
    assert got[6].n_markov == 0 and got[7].n_markov == 1
    clean = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert "abc123def" not in clean[1] and clean[6] == TRICKY[6] and clean[7] == "key [SECRET]" and clean[3].startswith("😀 api_key=é ")
    assert secrets.scan(edge).count() == edge.count() and secrets.scan(empty).count() == 0
    assert secrets.redact(edge).columns == edge.columns


def test_markov_on_labelled_samples(spark):
    held = secrets.labelled_samples(300, seed=99)
    df = spark.createDataFrame(held, "word string, random boolean")
    model = secrets.train(secrets.labelled_samples())
    got = df.select("random", (secrets.ratio(F.col("word"), model) > 10.0).alias("flag")).collect()
    assert np.mean([r.random == r.flag for r in got]) > 0.9
    assert np.mean([r.flag for r in got if not r.random]) < 0.02


def test_keys_behind_names_and_paths(spark):
    rng = random.Random(4)
    names = ["database_connection_string=", "connection_string=", "org/api/v1/users/session/reset/token/", "a-long-run-of-ordinary-words-before-the-key-", "user_name_of_the_request="]
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=32)) for _ in names]
    df = spark.createDataFrame([(i, f"see {n}{k}{tail} end") for i, (n, k) in enumerate(zip(names, keys)) for tail in ("", "/index/of/the/other/items")], "doc_id long, text string")
    assert all(r.n_markov == 1 for r in secrets.scan(df).collect())
    assert all(r.text == "see [SECRET] end" for r in secrets.redact(df).collect())
    plain = spark.createDataFrame([(i, n + "index/of/the/other/items") for i, n in enumerate(names)], "doc_id long, text string")
    assert all(r.n_markov == 0 for r in secrets.scan(plain).collect())
