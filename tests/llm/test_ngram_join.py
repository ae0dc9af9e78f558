"""op6 and the pipeline against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join as N


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(4)
    base, rows = words(rng, 120), []
    for i in range(50):  # a group of near copies that fills its buckets
        w = list(base)
        w[rng.randrange(120)], w[rng.randrange(120)] = f"zz{i}", f"yy{i % 7}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(base)) for i in range(30)]  # exact copies
    for k in range(12):  # small groups of rising distance
        own = words(rng, 80)
        for i in range(3):
            w = list(own)
            for _ in range(i * k // 3):
                w[rng.randrange(80)] = f"q{rng.random()}"
            rows.append((3000 + 10 * k + i, " ".join(w)))
    rows += [(5000 + i, " ".join(words(rng, 60))) for i in range(20)]
    rows += [(6000, None), (6001, ""), (6002, "one two"), (6003, "One  two"), (None, "a b c d e f g"), (6005, "a b c d e f g"), (6005, "a b c d e f g"), (6006, " ".join(words(rng, 5000)))]
    return rows


def brute(rows, threshold=0.8):
    sets = [frozenset(N.shingles(t).tolist()) for _, t in rows]
    parent, links = list(range(len(rows))), collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) / len(a | b) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return collections.Counter((rows[i][0], least[find(i)], links[i]) for i in range(len(rows))), set(least.values())


@pytest.mark.parametrize("block", [7, 1024])
def test_join(spark, copies, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_DOCS", block)
    df = spark.createDataFrame(copies, "doc_id long, text string").selectExpr("*", "'x' as digest", "'y' as bucket", "1 as n")
    want, kept = brute(copies)
    assert collections.Counter((r.doc_id, r.class_id, r.n_links) for r in N.join_documents(df).collect()) == want
    if block == 1024:
        one = N.keep_one(df)
        assert one.columns == df.columns
        assert sorted(r.doc_id for r in one.where("doc_id is not null").collect()) == sorted(k for k in kept if k is not None)


def test_links_do_not_depend_on_the_size_of_buckets(spark, monkeypatch):
    """Near copies of one text, many of them around the threshold: small buckets, one cluster, and both mixed say the same."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(70):
        words = list(base)
        for i in rng.integers(0, 120, rng.integers(0, 6)):
            words[i] = f"v{k}-{i}"
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    told = []
    for small in (2, 16, 1000):
        monkeypatch.setattr(N, "SMALL", small)
        told.append(sorted((r.doc_id, r.class_id, r.n_links) for r in N.join_documents(docs).collect()))
    assert told[0] == told[1] == told[2]
    assert len({n for _, _, n in told[0]}) > 5


def test_keep_one_of_repeated_and_null_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e, g, h, k = (" ".join(words(rng, 30)) for _ in range(8))
    near = a + " zz"
    rows = [(1, a), (2, near), (2, b), (3, c), (3, d), (4, e), (5, e), (4, a), (None, g), (None, g), (None, a), (6, h), (6, h), (7, ""), (7, ""), (8, None), (None, ""), (9, k)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'y' as digest")
    want = [(1, a), (2, b), (3, c), (3, d), (4, e), (None, g), (6, h), (7, ""), (8, None), (None, ""), (9, k)]
    one = N.keep_one(df)
    assert one.columns == df.columns
    assert collections.Counter((r.doc_id, r.text) for r in one.collect()) == collections.Counter(want)


def test_plan_reaches_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = N.band_plan(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 160


def test_plan_out_of_reach():
    with pytest.raises(ValueError):
        N.band_plan(0.05, 0.9999)


def test_vertex_names_sort_by_id(spark):
    ids = [None, -(2**63), -5, -1, 0, 1, 7, 2**31, 2**63 - 1]
    rows = spark.createDataFrame([(i, bytes([k] * 16)) for i in ids for k in (0, 255)], "id long, digest binary")
    got = rows.select("*", N.vertex_of(rows.id, rows.digest).alias("v")).select("*", N.least_id(F.col("v")).alias("back")).collect()
    assert all(bytes(r.v) == N._vertex(r.id, bytes(r.digest)) and r.back == r.id for r in got)
    assert [(r.id, bytes(r.digest)) for r in sorted(got, key=lambda r: bytes(r.v))] == sorted(((r.id, bytes(r.digest)) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def test_recall_of_candidates(spark):
    """Pairs at 0.8 or more of different texts, by brute force through common shingles, that share a band."""
    rng, sets = random.Random(5), {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        words = (r.text or "").split()
        for k in range(4 if 60 <= len(words) <= 600 else 1):  # near copies of many documents, at all similarities
            w = list(words)
            for _ in range(k and rng.randint(1, max(1, len(w) // 50))):
                w[rng.randrange(len(w))] = f"q{rng.randrange(9)}"
            own = N.shingles(" ".join(w))
            if len(own):
                sets[N._digest(own)] = own
    names, holders = list(sets), collections.defaultdict(list)
    for i, d in enumerate(names):
        for x in sets[d].tolist():
            holders[x].append(i)
    common = collections.Counter()
    for own in holders.values():
        if len(own) > 1:
            common.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    near = {(a, b): j for (a, b), n in common.items() if (j := n / (len(sets[names[a]]) + len(sets[names[b]]) - n)) >= 0.8}
    band = N.Bands(*N.band_plan())
    bands = [set(band(sets[d]).tolist()) for d in names]
    met = sum(bool(bands[a] & bands[b]) for a, b in near)
    print(f"{met} of {len(near)} pairs, {sum(j < 0.85 for j in near.values())} of them below 0.85")
    assert len(near) > 500 and met >= 0.99 * len(near)


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.choice(400, rng.integers(1, 300))).astype(np.uint64) for _ in range(60)]
    first, second = np.arange(25), np.arange(25, 60)
    want = [[len(set(sets[i].tolist()) & set(sets[j].tolist())) for j in second] for i in first]
    assert (N.intersections(sets, first, second) == want).all()


def test_components(spark):
    rng, edges = random.Random(1), []
    for base in range(0, 500, 50):  # chains, shuffled
        ids = list(range(base, base + 50))
        rng.shuffle(ids)
        edges += list(zip(ids, ids[1:], strict=False))
    got = N.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.vertex: r.component for r in got} == {v: v // 50 * 50 for v in range(500)}


def test_empty(spark, empty, edge):
    assert N.join_documents(empty).count() == 0 and N.keep_one(empty).count() == 0
    assert N.join_documents(edge).count() == edge.count()


def unique_rows(rows):
    """The ids that keep_one() leaves of (doc_id, text): the least id of each class."""
    return brute(rows)[1]


def test_pipeline(spark):
    """run() against each stage's rule in plain Python; fitted models and drawn keys are taken from their operators, run one by one."""
    import corpus_pipeline as P
    from corpusloom.llm import bpe, mixing, quality, secrets
    from corpusloom.session import read_table
    from tokenizers import Tokenizer
    from public_tokenizers import path

    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    model = quality.fit_labels(docs, read_table(spark, sf, "labels"))
    text, source = ({r.doc_id: r[c] for r in docs.collect()} for c in ("text", "source"))
    kept = [i for i in sorted(text) if quality_kept(model, text[i])]
    unique = unique_rows([(i, text[i]) for i in kept])
    scanned = {r.doc_id: r.spans for r in secrets.scan(docs.where(docs.doc_id.isin([*unique]))).collect()}
    clean = {i: redacted(text[i], scanned[i]) for i in unique}
    rows = spark.createDataFrame([(i, clean[i], source[i]) for i in unique], "doc_id long, text string, source string")
    times = {r.doc_id: r.epochs for r in mixing.mix(rows).collect()}
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i in unique:
        ids = lib.encode(clean[i], add_special_tokens=False).ids
        want[i, tuple(ids)] += times[i]
        assert bpe.decode(ids, path("byte_bpe_50k.json")) == clean[i]
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in P.run(spark, sf).collect()) == +want


def quality_kept(model, text):
    from corpusloom.llm import quality

    stats, x = quality.statistics(text)
    if stats[0] < 50 or 100 * stats[4] > 50 * stats[0]:
        return False
    total = model.base
    for node in model.roots.tolist():
        while model.left[node] != node:
            node = model.left[node] if x[model.feature[node]] < model.threshold[node] else model.right[node]
        total += model.value[node]
    return 1 / (1 + np.exp(-total)) >= 0.35


def redacted(text, spans):
    gone, out, at = sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s), [], 0
    for start, end in gone:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_quality_verdicts(spark, docs, edge):
    from corpusloom.llm import quality

    model = quality.fit_labels(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    for df in (docs, edge):
        rows = quality.score_documents(df, model).collect()
        texts = collections.Counter((r.doc_id, quality_kept(model, r.text)) for r in df.collect())
        assert collections.Counter((r.doc_id, r.kept) for r in rows) == texts


@pytest.mark.parametrize("clash", ["edge", "empty"])
def test_stages_on_odd_tables(spark, edge, empty, clash):
    """Nulls, empty and long texts, repeated rows, empty tables and clashing columns through every stage but the first's fit."""
    import corpus_pipeline as P
    from corpusloom.llm import quality, secrets

    df = (edge if clash == "edge" else empty).selectExpr("*", "1 as spans", "2 as before", "3 as gone_id", "4 as winner", "5 as own_digest", "6 as plan_size")
    model = quality.fit_labels(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    n = df.count()
    counts = []
    for out in (quality.keep_good(df, model), secrets.redact(df), *(stage(spark, df, "") for _, stage in P.STAGES[1:4])):
        assert out.columns == df.columns
        counts.append(out.count())
    # no row passes the base rules; one row of two copies goes with the near duplicates; secrets keep every row; rows with words are mixed
    assert counts[:4] == ([0, n, n - 1, n] if clash == "edge" else [0, 0, 0, 0])
    assert 0 < counts[4] <= 2 * n if clash == "edge" else counts[4] == 0
    assert P.STAGES[4][1](spark, df, "").count() == df.count()
    again = secrets.redact(df).where("spans = 1 and before = 2").count()
    assert again == df.count()
