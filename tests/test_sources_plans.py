"""Readers, sinks, configuration, plans, splits, clustering, alignment and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import alignment, batching, cluster, manifest, numeric, sequences
from corpusloom.plans import config, plan
from corpusloom.sources import readers, sinks
from corpusloom.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_corpus_precedence(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_corpus(spark, str(tmp_path))
    (tmp_path / "metadata.csv").write_text("file_name,transcript,duration,channel\na/b/c.wav,hello,2.5,\nx.wav, ,bad,me\n", encoding="utf-8")
    rows = {r.uid: r for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert rows["c"].text == "hello" and rows["c"].speaker == "default" and rows["x"].text is None and rows["x"].duration == 0
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata/train.jsonl").write_text('{"id": "1", "text": "a"}\n\n{"id": "2", "text": "b", "split": "dev"}\n', encoding="utf-8")
    assert {r.uid: r.split for r in readers.read_corpus(spark, str(tmp_path)).collect()} == {"1": "train", "2": "dev"}
    assert readers.missing_artefacts(spark, {str(tmp_path / "no"): "stage one", str(tmp_path / "metadata"): "two"}) == [f"{tmp_path}/no (made by stage one)"]


def test_numbering_and_sinks(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    got = sorted(r.uid for r in readers.numbered(df, ["k"]).collect())
    assert got == [f"pq_{i:06d}" for i in range(500)]
    made = []
    for _ in range(2):
        sinks.cached_table(spark, str(tmp_path / "t"), lambda: made.append(1) or df).count()
    assert len(made) == 1
    labels = spark.createDataFrame([("u1", 3, 1)], "uid string, pos int, code int")
    assert sinks.parse_label_keys(sinks.label_keys(labels)).collect() == labels.collect()
    with pytest.raises(ValueError, match="499 rows written for 500 read"):
        sinks.write_external(df, lambda x: x.where("k <> 'k7'"), str(tmp_path / "e"))
    assert not list(tmp_path.glob("e*"))
    assert sinks.write_external(df, lambda x: x.withColumn("m", F.upper("k")), str(tmp_path / "e")) == {"n_read": 500, "n_written": 500}
    assert spark.read.parquet(str(tmp_path / "e")).count() == 500


def test_metrics_of_a_running_write(spark, tmp_path):
    df = spark.range(100).withColumn("s", F.when(F.col("id") % 4 == 0, "a").otherwise("b"))
    path = str(tmp_path / "t")
    scans = spark.sparkContext.accumulator(0)
    got = sinks.write_observed(df, path, {"n": F.count(F.lit(1)), "low": F.count_if(F.col("id") < 10)}, keep=F.col("s") == "a", partition_by="s")
    assert got == {"n": 100, "low": 10} and spark.read.parquet(path).count() == 25 and scans.value == 0
    with pytest.raises(ValueError, match="too few"):
        sinks.write_observed(df.limit(5), path, {"n": F.count(F.lit(1))}, lambda m: "too few" if m["n"] < 50 else None)
    assert spark.read.parquet(path).count() == 25 and len(list(tmp_path.iterdir())) == 1  # what stood there stays, nothing else is left


def test_models_and_variants(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(w, int(i), (rng.normal(0, 0.1, 6) + (3 if i % 2 else -3) * np.eye(6)[1]).tolist(), None) for w in ("a", "b") for i in range(60)], "word string, uid long, vector array<double>, seconds double")
    models = cluster.fit_codes(rows)
    sinks.save_models(models, str(tmp_path / "m"))
    loaded = sinks.load_models(spark, str(tmp_path / "m"))
    assert sorted(map(repr, loaded.collect())) == sorted(map(repr, models.collect()))
    code = lambda m: sorted((r.word, r.uid, r.code) for r in cluster.assign_codes(rows, m.where("n_codes > 1")).collect())
    assert code(loaded) == code(models) != []
    sinks.save_models(models.withColumn("mean", F.slice("mean", 1, 3)), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="doesn't fit"):
        sinks.load_models(spark, str(tmp_path / "bad")).select("n_codes").collect()
    texts = spark.createDataFrame([(1, "abc"), (2, "ab"), (3, "x"), (4, ""), (5, None)], "uid int, text string")
    sinks.save_variants(spark.createDataFrame([(1, [0, 2, 9]), (2, [1])], "uid int, variants array<int>"), str(tmp_path / "v"))
    assert {r.uid: r.variants for r in sinks.load_variants(spark, str(tmp_path / "v"), texts).collect()} == {1: [0, 2, 9], 2: [0, 0], 3: [0], 4: [], 5: []}
    with pytest.raises(Exception, match="no digit"):
        sinks.save_variants(spark.createDataFrame([(1, [11])], "uid int, variants array<int>"), str(tmp_path / "w"))


def test_reading_report(spark, tmp_path):
    lex = spark.createDataFrame([("one", ["p"], [9], ["One"], 9), ("lead", ["a", "b"], [30, 10], ["Lead", "lead"], 40), ("rose", ["a", "b"], [5, 5], ["Rose", "rose"], 10)], sinks.LEXICON)
    sinks.reading_report(lex, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines[0] == "lead  40 uses, 2 readings" and lines[3] == "rose  10 uses, 2 readings" and len(lines) == 6
    assert lines[1].split() == ["0", "Lead", "30", "75.0%"] and lines[2].split() == ["1", "lead", "10", "25.0%"]


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"name": "a", "text": {"max_chars": 100, "max_words": 5}}')
    (tmp_path / "b.json").write_text('{"_base_": "a.json", "text": {"max_chars": 200}}')
    (tmp_path / "text.json").write_text('{"text": {"max_chars": "200"}}')
    with pytest.raises(TypeError):  # a string is no number
        config.load(tmp_path / "text.json")
    got = config.load(tmp_path / "b.json", {"inference.top_k": 7})
    assert (got.name, got.text.max_chars, got.text.max_words, got.inference.top_k) == ("a", 200, 5, 7)
    config.save(got, tmp_path / "c.json")
    assert config.load(tmp_path / "c.json") == got
    (tmp_path / "d.json").write_text('{"_base_": "d.json"}')
    for path, overrides, error in [("d.json", {}, ValueError), (None, {"text.nope": 1}, KeyError), (None, {"text.max_chars": "x"}, TypeError), (None, {"text.lower": 3}, TypeError), (None, {"inference.tau_low": 0.9}, ValueError)]:
        with pytest.raises(error):
            config.load(tmp_path / path if path else None, overrides)
    assert json.loads((tmp_path / "c.json").read_text())["name"] == "a"


def test_plan(spark):
    lexicon = spark.createDataFrame([("lead", ["a", "b"], [30, 10]), ("row", ["x"], [9])], "word string, patterns array<string>, counts array<long>")
    texts = spark.createDataFrame([(1, "Lead a row, lead"), (2, "plain")], "uid int, text string")
    p = plan.analyze(texts, lexicon, marked=spark.createDataFrame([(1, 0, 1), (1, 2, 5)], "uid int, idx int, code int"))
    got = {(r.uid, r.idx): (r.n_codes, r.code, r.from_user) for r in p.collect()}
    assert got == {(1, 0): (2, 1, True), (1, 1): (1, 0, False), (1, 2): (1, 0, False), (1, 3): (2, 0, False), (2, 0): (1, 0, False)}
    changed = plan.set_reading(plan.set_code(p, 1, 0, 0), lexicon, 1, 3, "b")
    assert {(r.uid, r.idx): r.code for r in changed.where("n_codes > 1").collect()} == {(1, 0): 0, (1, 3): 1}
    depth = {r.uid: (r.n_hard, r.depth) for r in plan.complexity(p).collect()}
    assert depth[2] == (0, 3) and depth[1] == (2, 8) and plan.hard_words(p).count() == 2
    assert plan.complexity(p, budget=0.5).where("depth > 3").count() == 0
    with pytest.raises(ValueError):
        plan.complexity(p, budget=0)


def test_splits_and_batches(spark):
    for n in (1, 10, 1000):
        rows = spark.range(n).withColumnRenamed("id", "uid")
        got = {r.split: r.n for r in manifest.assign_splits(rows, "uid").groupBy("split").agg(F.count("*").alias("n")).collect()}
        k = max(1, int(0.04 * n))
        assert got.get("dev", 0) == min(k, n) and got.get("test", 0) == min(k, max(0, n - k)) and sum(got.values()) == n
    given = spark.createDataFrame([(1, "test"), (2, None), (3, None), (4, None)], "uid long, split string")
    assert manifest.assign_splits(given, "uid").where("uid = 1").first().split == "test"
    rows = spark.range(997).select(F.col("id").alias("uid"), (10 + F.col("id") * 7919 % 240).alias("len"))
    p = batching.batch_plan(rows, "uid", "len", 8).cache()
    assert p.count() == 997 and p.groupBy("bucket", "batch", "slot").count().where("count > 1").count() == 0
    assert batching.padding_waste(p, rows, "uid", "len").first().waste < 0.12
    assert batching.batch_plan(rows, "uid", "len", 8, drop_last=True).groupBy("bucket", "batch").count().where("count <> 8").count() == 0
    got = [(r.uid, r.start) for r in batching.ragged_offsets(rows, "uid", "len").orderBy("uid").collect()]
    lengths = [10 + i * 7919 % 240 for i in range(997)]
    assert got == [(i, sum(lengths[:i])) for i in range(997)]


def test_viterbi(spark):
    scores = np.full((12, 6), -9.0)
    for t, k in enumerate([0, 1, 1, 2, 2, 0, 0, 2, 0, 3, 3, 0]):
        scores[t, k] = -0.1
    assert [(s, e) for s, e, _ in sequences.viterbi(scores, [1, 2, 2, 3])] == [(1, 3), (3, 5), (7, 8), (9, 11)]
    with pytest.raises(ValueError):
        sequences.viterbi(scores[:3], [1, 2, 3])
    df = spark.createDataFrame([(1, scores.tolist(), [1, 2, 2, 3]), (2, scores[:2].tolist(), [1, 2, 3])], "uid long, scores array<array<double>>, targets array<int>")
    assert {r.uid: len(r.spans) for r in alignment.forced_align(df).collect()} == {1: 4, 2: 0}


def test_clusters():
    rng, p = np.random.default_rng(0), cluster.Clustering(n_bootstrap=8)
    a, b = rng.normal(0, 0.25, (70, 64)) + rng.normal(0, 1, 64), rng.normal(0, 0.25, (50, 64)) + rng.normal(0, 1, 64)
    label, stable, *_ = cluster.codes_of(np.vstack([a, b]), None, p, 1)
    assert label.max() == 1 and (label[:70] == 0).all() and (label[70:] == 1).all() and stable > 0.95
    assert cluster.codes_of(rng.normal(0, 1, (120, 64)), None, p, 1)[0].max() == 0
    assert cluster.codes_of(a[:6], None, p, 1)[0].max() == 0
    seconds = np.r_[np.full(70, 0.2), np.full(50, 0.9)] + rng.normal(0, 0.01, 120)
    assert cluster.codes_of(np.vstack([a, b]), seconds, p, 1)[0].max() == 0


def test_every_row_of_a_word_gets_a_code(spark, monkeypatch):
    monkeypatch.setattr(cluster, "ROWS_PER_GROUP", 100)
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, 16), rng.normal(0, 1, 16)
    rows = [("two", i, (rng.normal(0, 0.2, 16) + (a if i % 5 < 3 else b)).tolist(), None) for i in range(300)]
    rows += [("one", 1000 + i, rng.normal(0, 1, 16).tolist(), None) for i in range(250)] + [("rare", 2000 + i, a.tolist(), None) for i in range(3)]
    df = spark.createDataFrame(rows, "word string, uid long, vector array<float>, seconds double")
    got = cluster.discover_codes(df, cluster.Clustering(cap=100, n_bootstrap=6)).collect()
    assert sorted((r.word, r.uid) for r in got) == sorted((w, u) for w, u, *_ in rows if w != "rare")
    assert all(r.code == (r.word == "two" and r.uid % 5 >= 3) and r.n_codes == 1 + (r.word == "two") for r in got)


def test_rules(spark):
    one = spark.range(1)
    assert one.select(sequences.early_stop(F.array(*[F.lit(x) for x in (1.0, 0.9, 0.8995, 0.899, 0.8985, 0.898)]), 3, 0.002)).first()[0] == 4
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0.0, 5.0), (4.0, 9.0), (5.0, 6.0), (5.5, 9.0), (6.0, 7.0))])
    assert [tuple(s) for s in one.select(sequences.monotonic_spans(spans)).first()[0]] == [(0.0, 5.0), (5.0, 6.0), (6.0, 7.0)]
    d = spark.createDataFrame([(0.9,)] + [(0.0,)] * 9, "d double")
    assert d.agg(numeric.pooled_difficulty(F.col("d"))).first()[0] > 0.8 and d.agg(numeric.pooled_difficulty(F.col("d") * 0)).first()[0] == 0


def test_streams(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.reading_counts(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = incremental.total_counts(spark, str(tmp_path / "out")).agg(F.sum("n"), F.count("*")).first()
    from corpusloom.functions import chars

    words = docs.select(F.explode(chars.words(F.col("text"))).alias("w"))
    assert got[0] == words.count() and got[1] == words.distinct().count()
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "ev"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    query = incremental.event_windows(source, "3650 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
    assert incremental.user_sessions(events).agg(F.sum("n")).first()[0] == events.count()
