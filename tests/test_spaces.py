"""Interval joins, merged moments and batched alignment against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import alignment, cluster, features, intervals, projection, sequences


def test_pairs_meet_once(spark):
    rng = np.random.default_rng(1)
    points = [(int(k), int(a), i) for i, (k, a) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(-50, 200, 400), strict=True))] + [(1, None, 900), (None, 5, 901)]
    spans = [(int(k), int(a), int(a + n), i) for i, (k, a, n) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-60, 190, 60), rng.choice([-3, 0, 1, 2, 7, 90], 60), strict=True))] + [(1, None, 9, 70), (2, 3, None, 71)]
    p, s = spark.createDataFrame(points, "k int, at int, p int"), spark.createDataFrame(spans, "k int, low int, high int, s int")
    want = sorted((b, d) for k, a, b in points if None not in (k, a) for j, lo, hi, d in spans if j == k and None not in (lo, hi) and lo <= a < hi)
    for width in (None, 1.0, 5.0, 1000.0):
        assert sorted((r.p, r.s) for r in intervals.points_in_intervals(p, s, ["k"], "at", "low", "high", width).collect()) == want
    assert intervals.points_in_intervals(p.limit(0), s, ["k"], "at", "low", "high").count() == intervals.points_in_intervals(p, s.limit(0), ["k"], "at", "low", "high").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        intervals.points_in_intervals(p, s.withColumn("p", F.lit(1)), ["k"], "at", "low", "high")


def test_fractions_and_ends(spark):
    p = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (3.9999,), (4.0,)], "at double").withColumn("k", F.lit(1))
    s = spark.createDataFrame([(1, 0.25, 4.0)], "k int, low double, high double")
    for width in (0.1, 1.0, 4.0):
        assert sorted(r["at"] for r in intervals.points_in_intervals(p, s, ["k"], "at", "low", "high", width).collect()) == [0.25, 1.0, 3.9999]


def test_one_long_utterance(spark):
    """A quarter of a million frames of one utterance: joined rows follow the matches, and no task reads them all."""
    n = 250_000
    frames = spark.range(n).select(F.lit(1).alias("uid"), F.col("id").cast("int").alias("t"), F.array(F.sin(F.col("id") / 50), F.col("id") / 1000).alias("vector"))
    spans = spark.range(n // 40).select(F.lit(1).alias("uid"), F.col("id").alias("word_index"), (F.col("id") * 40 / 100.0).alias("start"), ((F.col("id") * 40 + 25) / 100.0).alias("end"))
    got = {r.word_index: r["mean"] for r in features.span_means(frames, spans, 100.0, 0.02, 2).collect()}
    x = np.stack([np.sin(np.arange(n) / 50), np.arange(n) / 1000], 1)
    x -= x.mean(0)
    sums = np.vstack([np.zeros(2), x.cumsum(0)])
    for w in (0, 1, 777, n // 40 - 1):
        a, b = max(0, int(np.floor((w * 40 / 100 - 0.02) * 100))), min(n, int(np.ceil(((w * 40 + 25) / 100 + 0.02) * 100)))
        assert np.allclose(got[w], (sums[b] - sums[a]) / (b - a), atol=1e-6)
    assert len(got) == n // 40
    cut = spans.selectExpr("uid", "word_index", "cast(word_index * 40 as int) as a", "cast(word_index * 40 + 25 as int) as b")
    dealt = intervals.points_in_intervals(frames, cut, ["uid"], "t", "a", "b")
    assert dealt.count() == 25 * (n // 40)


def test_characters_of_words(spark):
    chars = spark.createDataFrame([("u", i) for i in range(6)] + [("v", 0)], "uid string, pos int")
    words = spark.createDataFrame([("u", 0, 1, 3), ("u", 1, 4, 5)], "uid string, word_index int, start int, end int")
    got = {(r.uid, r.pos): r.word_index for r in intervals.char_words(chars, words).collect()}
    assert got == {("u", 0): -1, ("u", 1): 0, ("u", 2): 0, ("u", 3): -1, ("u", 4): 1, ("u", 5): -1, ("v", 0): -1}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    return rng.normal(0, 1, (700, 12)) @ rng.normal(0, 1, (12, 12)) + 1e4


@pytest.mark.parametrize("parts", [1, 7, 80])
def test_moments_merge(spark, vectors, parts, monkeypatch):
    monkeypatch.setattr(projection, "FAN", 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9999, None)], "vec_id long, v array<double>").repartition(parts, "vec_id")
    m = projection.moments(df, "v", 12)
    c = vectors - vectors.mean(0)
    assert m.n == 700 and np.allclose(m.mean, vectors.mean(0)) and np.allclose(m.scatter, c.T @ c, rtol=1e-8)
    p = projection.fit(df, "v", 12, 5)
    mean, axes, scale = cluster.fit_projection(vectors, 5)
    axes = axes * np.sign(axes[np.arange(5), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose(p.axes, axes, atol=1e-6) and np.allclose(p.scale, scale, rtol=1e-6)
    got = projection.project(df, "vec_id", "v", p).collect()
    assert [r.coordinates for r in got if r.uid == 9999] == [None]
    for r in got[:50]:
        if r.uid != 9999:
            assert np.allclose(r.coordinates, (vectors[r.uid] - mean) @ axes.T * scale, atol=1e-6)


def test_whitened_coordinates(spark, vectors):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, v array<double>").repartition(3)
    got = projection.project(df, "vec_id", "v", projection.fit(df, "v", 12, 4, whiten=True)).orderBy("uid").collect()
    z, want = np.array([r.coordinates for r in got]), cluster.whitened(vectors, 4)
    assert np.allclose(z.std(0, ddof=1), 1, atol=1e-9) and np.allclose(np.abs(z), np.abs(want), atol=1e-5)


def test_odd_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, v array<double>")
    assert projection.moments(empty, "v", 3).n == 0
    assert projection.fit(empty, "v", 3, 2).axes.shape == (1, 3)
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, v array<double>")
    assert projection.project(one, "vec_id", "v", projection.fit(one, "v", 3, 2)).first().coordinates == [0.0]
    for bad in ([1.0, 2.0], [1.0, None, 2.0]):
        with pytest.raises(Exception, match="3 values"):
            projection.moments(spark.createDataFrame([(1, bad)], "vec_id long, v array<double>"), "v", 3)


def utterances(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        t = int(rng.integers(1, 60))
        out.append((np.log(rng.dirichlet(np.full(5, 0.3), t)), rng.integers(1, 5, int(rng.integers(0, 14))).tolist()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_single_utterances(seed):
    rows = utterances(seed, 80)
    rows.append((np.zeros((30, 5)), [1, 1, 2, 2]))  # all ties
    rows.append((np.zeros((0, 0)), [1]))
    got = alignment.align_batch([s for s, _ in rows], [t for _, t in rows])
    for (scores, targets), spans in zip(rows, got, strict=True):
        try:
            want = sequences.viterbi(scores, targets)
        except ValueError:
            want = []
        assert [x[:2] for x in spans] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in spans], [x[2] for x in want])
    assert sum(map(bool, got)) > 30


def test_moves_are_kept_for_one_stretch_only(monkeypatch):
    scores, targets = np.log(np.random.default_rng(3).dirichlet(np.ones(4), 900)), [1, 2, 3] * 20
    trellis, seen = alignment._Trellis([scores], [targets], 0), []
    step = trellis.step
    monkeypatch.setattr(trellis, "step", lambda a, t: seen.append(t) or step(a, t))
    trellis.paths()
    assert len(seen) <= 2 * 900  # each frame is computed twice at most
    assert alignment.align_batch([scores], [targets])[0] == sequences.viterbi(scores, targets)


def test_align_table(spark, monkeypatch):
    rows = utterances(5, 30)
    df = spark.createDataFrame([(f"u{i}", s.tolist() if len(s) else [], t) for i, (s, t) in enumerate(rows)], "uid string, scores array<array<double>>, targets array<int>")
    odd = spark.createDataFrame([("n1", None, [1]), ("n2", [[0.0, 1.0]] * 9, None), ("n3", [[0.0, 1.0], [0.0]], [1]), ("n4", [[0.0, 1.0]] * 9, [7]), ("n5", [[0.0, 1.0]] * 9, [1, None])], df.schema)
    got = {r.uid: [tuple(s)[:2] for s in r.spans] for r in alignment.forced_align(df.unionByName(odd).repartition(3)).collect()}
    assert all(got[f"n{i}"] == [] for i in range(1, 6)) and len(got) == 35
    want = alignment.align_batch([s for s, _ in rows], [t for _, t in rows])
    assert all(got[f"u{i}"] == [x[:2] for x in w] for i, w in enumerate(want))


def test_blank_and_script_of_a_vocabulary():
    assert alignment.blank_of({"a": 1, "<pad>": 5, "<blank>": 9}) == 9 and alignment.blank_of({"<s>": 3, "<pad>": 5}) == 5 and alignment.blank_of({"<s>": 3}) == 3
    assert alignment.blank_of({"a": 1}, 7) == 7 and alignment.blank_of({"a": 0}) == 0
    assert alignment.is_romanised({c: i for i, c in enumerate("abcdefghij")}) and not alignment.is_romanised({c: i for i, c in enumerate(alignment.ARABIC_LETTERS)})
