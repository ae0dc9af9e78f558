"""Rules on a stream against the batch forms; the reading state against the miner."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chars
from corpusloom.operators import reading_state, readings, sequences
from corpusloom.streaming import ordered

SCHEMA = "user string, ts timestamp, n long, kind string"


def batches(spark):
    """Three arrivals of events, out of order within a day, with nulls, ties in time, and a null key."""
    rows = spark.range(400).selectExpr(
        "case when id % 7 = 3 then null else concat('u', id % 5) end as user", "timestamp_seconds(1700000000 + 3600 * (id div 2)) as ts", "id as n", "case when id % 11 = 0 then null when id % 50 < 30 then 'a' else concat('k', id % 3) end as kind"
    )
    late = F.pmod(F.xxhash64("n"), F.lit(4)) == 0
    third = F.floor(F.col("n") / 134)
    return [rows.where(F.least(third + late.cast("int"), F.lit(2)) == k) for k in range(3)], rows


def start(spark, folder, window=4, repeats=2, run=3, least=2):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rules = ordered.ordered_rules(stream, "user", "ts", "n", "kind", "10 days", window, repeats, run, least)
    ordered.append(rules, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()


def close(spark, folder, day=400):
    end = spark.sql(f"select 'zz' as user, timestamp_seconds(1700000000 + 86400 * {day}) as ts, -1L as n, 'end' as kind")
    end.write.mode("append").parquet(f"{folder}/in")


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    parts, rows = batches(spark)
    for part in parts[:2]:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start(spark, tmp_path)
    part_way = spark.read.parquet(f"{tmp_path}/out").count()
    parts[2].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    close(spark, tmp_path)
    start(spark, tmp_path)  # from the checkpoint
    assert part_way < 400
    got = spark.read.parquet(f"{tmp_path}/out")
    want = sequences.repetition_guard(rows, "user", ["ts", "n"], "kind", 4, 2)
    want = sequences.end_of_run(want, "user", ["ts", "n"], "kind", 3, 2)
    key = lambda r: (r.n, r.user, r.kind, bool(r.banned), bool(r.ended))
    assert sorted(map(key, got.collect()), key=repr) == sorted(map(key, want.collect()), key=repr)


def test_late_rows_are_left_out(spark, tmp_path):
    parts, _ = batches(spark)
    parts[0].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    close(spark, tmp_path)
    start(spark, tmp_path)
    before = spark.read.parquet(f"{tmp_path}/out").count()
    parts[1].coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    close(spark, tmp_path, 800)
    start(spark, tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert before == parts[0].count() and got.where("n >= 0").count() == before and got.where("n < 0").count() == 1


def test_rules_look_back_no_further_than_they_need():
    rules = ordered.Rules(3, 2, 2, 0)
    said = [rules.judge(v) for v in ["a", "b", "a", "a", None, "c", "c", "x"]]
    assert [b for b, _ in said] == [False, False, False, True, False, False, False, False]
    assert [e for _, e in said] == [False, False, False, True, True, True, True, True]
    assert len(rules.last) == 3
    assert ordered.Rules(3, 2, 2, 0, rules.held()).judge("c") == rules.judge("c")


def occurrences(rows):
    return readings.occurrences(rows.select(F.col("doc_id").alias("uid"), "text"), chars.words(F.col("text")), chars.fold_latin, lambda t: t)


def lexicon(df):
    return sorted(tuple(r) for r in df.select("word", "code", "pattern", "n", "example", "total").collect())


@pytest.fixture(scope="module")
def words(spark):
    return spark.range(90).selectExpr("id as doc_id", "concat_ws(' ', 'the', if(id % 3 = 0, 'Lead', 'lead'), if(id % 3 = 0, 'pipe', 'on'), concat('w', id % 9), if(id % 2 = 0, 'Rose', 'rose'), concat('x', id % 4), upper(substring(md5(string(id)), 1, 1)), substring(md5(string(id)), 1, 1)) as text")


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_batches_in_any_order(spark, words, tmp_path, order):
    want = lexicon(readings.mine(occurrences(words)))
    assert {c for _, c, *_ in want} >= {0, 1}
    state = reading_state.ReadingState(spark, str(tmp_path / "s"))
    for k in order:
        state.add(occurrences(words.where(f"doc_id % 3 = {k}")), f"b{k}")
        if k == 2:
            state.compact()
    assert lexicon(state.lexicon()) == want
    state.compact()
    assert lexicon(state.lexicon()) == want
    assert len(list((tmp_path / "s").glob("merged-*"))) == 1 and not list((tmp_path / "s").glob("batch-*"))


def test_a_batch_added_twice_counts_once(spark, words, tmp_path):
    state = reading_state.ReadingState(spark, str(tmp_path / "s"))
    for part in ("doc_id < 50", "doc_id < 30", "doc_id < 50"):
        state.add(occurrences(words.where(part)), "one")
    state.add(occurrences(words.where("doc_id >= 50")), "two")
    assert lexicon(state.lexicon()) == lexicon(readings.mine(occurrences(words)))
    state.compact()
    with pytest.raises(ValueError, match="merged"):
        state.add(occurrences(words), "one")
    with pytest.raises(ValueError, match="no batch"):
        reading_state.ReadingState(spark, str(tmp_path / "t")).lexicon()


def test_contexts_of_hopeless_words_go(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a W{i % 2}x wX wx Wx WX b") for i in range(30)], "doc_id long, text string")
    state = reading_state.ReadingState(spark, str(tmp_path / "s"))
    occ = readings.occurrences(rows.select(F.col("doc_id").alias("uid"), "text"), chars.words(F.col("text")), lambda t: F.when(F.lower(t).startswith("w"), F.lit("w")).otherwise(t), lambda t: t)
    state.add(occ, "one")
    before = lexicon(state.lexicon())
    state.compact()
    assert state.contexts().where("word = 'w'").count() == 0 < state.contexts().count()
    assert lexicon(state.lexicon()) == before == lexicon(readings.mine(occ))


def test_documents_as_a_stream(spark, words, tmp_path):
    words.where("doc_id < 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state = reading_state.ReadingState(spark, str(tmp_path / "s"))
    run = lambda: reading_state.maintain(spark.readStream.schema(words.schema).parquet(f"{tmp_path}/in"), occurrences, state, f"{tmp_path}/c").awaitTermination()
    run()
    words.where("doc_id >= 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert lexicon(state.lexicon()) == lexicon(readings.mine(occurrences(words)))
