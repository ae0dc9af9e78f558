"""Packing of keys by cost, centroids in blocks, and the functions that SQL calls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chars, register
from corpusloom.operators import cluster, numeric, packing, readings, sequences


@pytest.mark.parametrize("tasks", [1, 4, 16])
def test_loads_are_even(spark, tasks):
    rng = np.random.default_rng(tasks)
    costs = [(f"k{i}", float(c)) for i, c in enumerate((rng.pareto(1.2, 3000) + 0.1) * 10)]
    most = sum(c for _, c in costs) / tasks
    costs = [(k, min(c, most)) for k, c in costs]
    df = spark.createDataFrame(costs, "word string, cost double")
    got = {r.word: r.task for r in packing.pack(df, "word", "cost", tasks).collect()}
    assert len(got) == 3000 and set(got.values()) <= set(range(tasks))
    loads = np.bincount([got[k] for k, _ in costs], weights=[c for _, c in costs], minlength=tasks)
    dearest = max(c for _, c in costs)  # a key is never split
    assert loads.max() < max(2 * loads.mean(), 1.05 * dearest)


def test_longest_first():
    placed, loads = packing.longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2)
    assert placed == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1} and sorted(loads) == [8, 10]
    assert packing.longest_first([], 3) == ({}, [0.0] * 3)


def test_rows_go_where_their_key_was_packed(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(500).selectExpr("concat('w', if(id < 200, 0, id % 40)) as word", "id")
        costs = rows.groupBy("word").agg(F.count("*").alias("cost"))
        packed = packing.pack(costs, "word", "cost", 4)
        dealt = packing.rows_by_task(rows, "word", packed, 4)
        where = {(r.word, r.p) for r in dealt.select("word", F.spark_partition_id().alias("p")).distinct().collect()}
        assert where == {(r.word, r.task) for r in packed.collect()}
        got = {r.word: r.n for r in packing.apply_by_key(dealt, "word", lambda x: x.groupby("word", as_index=False).agg(n=("id", "count")), "word string, n long").collect()}
        assert got == {r.word: r.cost for r in costs.collect()}
        none = packing.pack(costs.limit(0), "word", "cost", 4)
        assert none.count() == 0 and packing.rows_by_task(rows, "word", none, 4).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dearest_words_share_no_task(spark):
    rng = np.random.default_rng(3)
    rows = [(f"w{w}", w * 1000 + i, rng.normal(0, 1, 4).tolist(), None) for w in range(8) for i in range(150 if w < 4 else 20)]
    df = spark.createDataFrame(rows, "word string, uid long, vector array<double>, seconds double")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        models = cluster.fit_codes(df, cluster.Clustering(n_bootstrap=2)).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(models) == 8 and len({m.p for m in models if m.n == 150}) == 4


def test_centroids_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, i % 17, rng.normal(0, 1, 3).tolist()) for i in range(200)], "vec_id long, label int, v array<double>")
    table = numeric.centroids(rows, "label", "v", 3)
    told = lambda: sorted((r.vec_id, r.nearest, round(r.d2, 9)) for r in numeric.nearest(rows, "vec_id", "v", table, "label").collect())
    gap = lambda: numeric.cluster_separation(rows, "label", "v", 3).first().separation
    one, apart = told(), gap()
    monkeypatch.setattr(numeric, "CENTROIDS", 3)
    assert told() == one and gap() == apart


def test_names_in_sql(spark):
    names = register.register(spark)
    assert {"align_tokens", "context_agreement", "latin_in_arabic"} <= set(names)
    plain, marked = "the lead pipe fell", "the léad big pipe"
    rows = [("u", s, i, t) for s, text in (("plain", plain), ("marked", marked)) for i, t in enumerate(text.split())] + [("v", "plain", 0, "alone")]
    tokens = spark.createDataFrame(rows, "uid string, side string, pos int, token string")
    tokens.withColumn("key", chars.fold_latin(F.col("token"))).createOrReplaceTempView("tokens")
    got = spark.sql("select * from align_tokens(table(tokens) partition by uid) order by uid, pos").collect()
    texts = spark.createDataFrame([(plain, marked)], "p string, m string").select(sequences.align_tokens(F.split("p", " "), F.split("m", " "), chars.fold_latin).alias("a"))
    assert [r.marked for r in got if r.uid == "u"] == texts.first().a
    assert [tuple(r) for r in got if r.uid == "v"] == [("v", 0, "alone", None)]
    occ = spark.range(60).selectExpr("'w' || id % 3 as word", "'l' || id % 2 as left", "'r' as right", "if(id % 7 = 0, 'a', 'b') as pattern").unionByName(spark.sql("select 'x' as word, 'l' as left, 'r' as right, 'a' as pattern"))
    counts = readings.contexts(occ)
    counts.createOrReplaceTempView("contexts")
    told = {r.word: r.a for r in spark.sql("select word, context_agreement(left, right, pattern, n) as a from contexts group by word").collect()}
    want = {r.word: r.agreement for r in readings.agreement_of(counts).collect()}
    assert told == pytest.approx(want) and told["x"] == 1.0
    assert spark.sql("select latin_in_arabic('ahmed') as a, latin_in_arabic(null) as b").first().b is None
