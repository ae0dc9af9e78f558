"""Plans and results that only showed their faults on larger tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom import queries as core
from corpusloom.functions import chars, marks, vocab
from corpusloom.operators import batching as B
from corpusloom.operators import cluster as C
from corpusloom.operators import reading_state
from corpusloom.operators import readings as R
from corpusloom.operators.reading_state import ReadingState
from corpusloom.queries import reading

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["char_word_join", "plan_char_codes", "ragged_slices", "events_in_windows"])
def test_no_side_goes_through_the_driver(spark, name):
    """Exploded sides look small to Spark: it broadcast the characters and codes of all texts."""
    assert "Broadcast" not in plan(core.all_queries()[name](spark, SF))


def test_characters_are_shuffled_once(spark):
    assert plan(core.all_queries()["char_word_join"](spark, SF)).count("Exchange hashpartitioning") == 3  # characters, spans, counts of texts


def test_marks_are_read_once_for_each_word(spark):
    """The pairs of letters and marks were read anew for each letter, several times over."""
    words = spark.range(3).select(F.concat(F.lit("كَتَب"), F.col("id").cast("string")).alias("w"))
    for own in (marks.vowel_pattern, marks.letter_variants):
        assert plan(words.select(own(F.col("w")).alias("x"))).count("regexp_extract_all") == 1


def test_number_words_of_many_parts(spark, tmp_path):
    """Keys of a table of this size give numbers of sixteen digits."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (o_orderkey + 10000000 as o_orderkey) from '{SF}/orders.parquet' limit 50) to '{tmp_path}/orders.parquet' (format parquet)")
    con.execute(f"copy (select * replace (p_partkey + 1200000 as p_partkey) from '{SF}/part.parquet' limit 50) to '{tmp_path}/part.parquet' (format parquet)")
    for t in ("orders", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = sorted(con.execute(core.all_sql()["number_words"]).fetchall())
    got = sorted(tuple(r) for r in core.all_queries()["number_words"](spark, str(tmp_path)).collect())
    assert got == want and any(n >= 10**15 for n, _ in got)


def test_contexts_are_shuffled_once(spark):
    """Occurrences were shuffled by pattern, then by context, then by word."""
    assert plan(core.all_queries()["context_agreement"](spark, SF)).count("Exchange hashpartitioning") == 2  # by context, by word


def test_scores_by_shapes_equal_predictions(spark):
    n = F.col("id")
    word = F.concat(F.lit("w"), (n % 5).cast("string"))
    occ = spark.range(4000).select(
        n.alias("uid"), F.lit(0).alias("pos"), word.alias("word"), F.concat(word, (F.hash("id") % 3).cast("string")).alias("pattern"), word.alias("form"),
        (F.hash(n + 1) % 40).cast("string").alias("left"), (F.hash(n + 2) % 3).cast("string").alias("right"), (F.hash(n + 3) % 10 == 0).alias("held"),
    )
    guesses = R.predict_by_neighbours(occ.where("not held"), occ.where("held"))
    want = {r.word: (r.n, r.a, r.b) for r in guesses.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("pattern") == F.col("guess")).alias("a"), F.count_if(F.col("pattern") == F.col("majority")).alias("b")).collect()}
    shapes = R.context_shapes(R.dealt_contexts(occ, None, F.count_if("held").alias("held")), "held")
    got = {r.word: (r.n, r.n_right, r.n_base) for r in R.neighbour_scores(shapes).collect()}
    assert got == want and len(got) == 5
    exact = {r.word: tuple(r) for r in R.agreement(R.contexts(occ)).collect()}
    assert {r.word: tuple(r) for r in R.shapes_agreement(shapes).collect()} == exact == {r.word: tuple(r) for r in R.agreement(R.dealt_contexts(occ)).collect()}


def test_texts_are_cut_once(spark):
    """The explode asked for arrays that aren't empty, below it, and each text was cut again for that."""
    assert plan(reading._occ(spark, SF).agg(F.count("word"))).split("FileScan")[0].count("regexp_extract_all") == 1


def test_contexts_counted_in_arrow_equal_predictions(spark):
    n = F.col("id")
    word = F.concat(F.lit("w"), (n % 5).cast("string"))
    pattern = F.when(F.hash("id") % 3 == 0, word).otherwise(F.concat(word, (F.hash("id") % 3).cast("string")))
    occ = spark.range(4000).select(
        n.alias("uid"), F.lit(0).alias("pos"), word.alias("word"), pattern.alias("pattern"), word.alias("form"),
        (F.hash(n + 1) % 40).cast("string").alias("left"), (F.hash(n + 2) % 3).cast("string").alias("right"), (F.hash(n + 3) % 10 == 0).alias("held"),
    )
    guesses = R.predict_by_neighbours(occ.where("not held"), occ.where("held"))
    want = {r.word: (r.n, r.a, r.b) for r in guesses.groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("pattern") == F.col("guess")).alias("a"), F.count_if(F.col("pattern") == F.col("majority")).alias("b")).collect()}
    shapes, patterns = R.dealt_shapes(occ, 4000, "held"), R.pattern_counts(occ, held=(F.count_if("held"), F.sum))
    named = R.named_shapes(shapes, patterns, "held")
    got = {r.word: (r.n, r.n_right, r.n_base) for r in R.neighbour_scores(named.where(F.exists("shape", lambda x: x["held"] > 0)), patterns).collect()}
    assert got == want and len(got) == 5
    exact = {r.word: tuple(r) for r in R.agreement(R.contexts(occ)).collect()}
    assert {r.word: tuple(r) for r in R.shapes_agreement(named).collect()} == exact
    hashes = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in exact}
    assert {r.word: tuple(r)[1:] for r in R.shapes_agreement(R.dealt_shapes(occ, 4000)).collect()} == {hashes[w]: x[1:] for w, x in exact.items()}


def test_counts_of_one_task_are_merged(monkeypatch):
    """A context that stands very often is one row after each merge."""
    monkeypatch.setattr(R, "ROWS_PER_COUNT", 10)
    rows = [(k % 3, 7, None if k % 2 else 5, int(k % 4 == 0)) for k in range(500)]
    whole = pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("word", "context", "pattern", "held"))})
    got = R._counted(iter(whole.to_batches(max_chunksize=7)), ["word", "context", "pattern"], True)
    want = Counter(r[:3] for r in rows)
    assert {(r["word"], r["context"], r["pattern"]): r["n"] for r in got.to_pylist()} == want and len(got) == 6
    assert sum(got["held"].to_pylist()) == 125
    assert R._counted(iter([]), ["word"], True) is None


def _shapes(rows):
    """How many contexts of each word have which counts."""
    at = Counter()
    for batch in rows:
        for r in batch.to_pylist():
            at[r["word"], tuple(sorted((x["pattern"], x["n"]) for x in r["shape"]))] += r["contexts"]
    return at


def test_first_pass_counts_tokens(spark):
    """Word, pattern and form were made for each occurrence, and their counts were sorted, as a hash aggregate holds no strings."""
    assert "SortAggregate" not in plan(R.pattern_counts(reading._texts(spark, SF)))
    far = 1 << 40
    docs = spark.createDataFrame([(far, "b A a"), (-far, "x b"), (5, "A a A x9"), (-7, "a B")], "uid long, text string")
    skip = lambda t: F.when(~t.contains("9"), F.lower(t))
    for pattern, form in ((None, None), (skip, None), (None, F.upper), (skip, F.upper)):
        texts = R.Texts(docs, F.split("text", " "), F.lower, pattern, form)
        got, want = (sorted(map(tuple, R.pattern_counts(o, low=(F.min("uid"), F.min)).collect()), key=str) for o in (texts, texts.occurrences()))
        assert got == want and len(got) in (3, 6)
    assert {r.pattern: r.first for r in R.pattern_counts(R.Texts(docs, F.split("text", " "), F.lower)).collect()} == {"b": (-far << 31) + 1, "A": 5 << 31, "a": -7 << 31, "x": -far << 31, "x9": (5 << 31) + 3, "B": (-7 << 31) + 1}


def test_contexts_of_texts_equal_those_of_rows(spark):
    """Each occurrence was a row of its own, which is moved alone."""
    docs = spark.createDataFrame([(k, None if k == 7 else "" if k == 8 else " ".join("aAbB9"[(k * j) % 5] for j in range(k % 13))) for k in range(400)], "uid long, text string")
    texts = R.Texts(docs, F.filter(F.split("text", ""), lambda c: c != " "), F.lower, lambda t: F.when(t != "9", t), None, ())
    got, want = (_shapes([R.dealt_shapes(o, 2000).toArrow()]) for o in (texts, texts.occurrences()))
    assert got == want and len(got) > 20
    assert plan(R.dealt_shapes(reading._texts(spark, SF), 2000)).split("FileScan")[0].count("regexp_extract_all") == 1
    assert plan(R.dealt_shapes(texts, 2000)).count("Exchange") == 1 and "Generate" not in plan(R.dealt_shapes(texts, 2000))


def test_concordance_sorts_no_occurrences(spark, monkeypatch):
    """All occurrences were sorted by word, pattern and place in each task, to find the first ones."""
    docs = spark.createDataFrame([(f"d{k * 7919 % 300}", None if k == 7 else " ".join("aAbB9"[(k * j) % 5] for j in range(k % 13))) for k in range(300)], "uid string, text string")
    texts = R.Texts(docs.repartition(3), F.split("text", " "), F.lower, lambda t: F.when(~t.isin("9", ""), t))
    lexicon = spark.createDataFrame([("a", "a", 0), ("a", "A", 1), ("b", "b", 0)], "word string, pattern string, code int")
    order = Window.partitionBy("word", "pattern").orderBy("uid", "pos")
    ranked = texts.occurrences().withColumn("k", F.row_number().over(order)).where("k <= 4 and word = 'a'")
    want = sorted((r.word, "aA".index(r.pattern), r.k, r.uid, r.pos) for r in ranked.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = R.first_places(texts, lexicon, 4)
        assert sorted(map(tuple, got.collect())) == want and len(want) == 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same = pa.record_batch({"words": [[0, 5, 5, 5, 9]] * 4, "patterns": [[5, 6, 5]] * 4, "uid": [3, 1, 1, 2]})
    got = [tuple(r.values()) for b in R._first_rows(iter([same]), 3) for r in b.to_pylist()]
    assert sorted(got) == [(5, 5, 1, 0), (5, 5, 1, 0), (5, 5, 1, 2), (5, 6, 1, 1), (5, 6, 1, 1), (5, 6, 2, 1)]


@pytest.mark.parametrize("collide", [False, True])
def test_blocks_hold_each_context_once(monkeypatch, collide):
    """A context that stands a million times was a million rows of one task; contexts of one number stay apart."""
    if collide:
        monkeypatch.setattr(R, "_mixed", lambda word, context: word * 0)
    rows = [(k % 3, 7 + k % 2, k % 5 // 4, int(k % 4 == 0)) for k in range(600)]
    whole = pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(("word", "context", "pattern", "held"))})
    blocks = list(R._blocks(iter(whole.to_batches(max_chunksize=70)), 9))
    moved = Counter()
    for b in blocks:
        for r in b.to_pylist():
            for w, c, p, n, h in zip(*(r[x] for x in ("word", "context", "pattern", "n", "held")), strict=True):
                moved[w, c, p] += n
                assert 0 <= r["part"] < 9 and h <= n
    assert moved == Counter(r[:3] for r in rows) and (collide or sum(len(x) for b in blocks for x in b["word"]) == 12)
    got, want = _shapes(R._shape_batches(iter(blocks), True)), Counter()
    for w in range(3):
        for c in (7, 8):
            want[w, tuple(sorted(((p, moved[w, c, p]) for p in (0, 1))))] += 1
    assert got == want
    assert list(R._shape_batches(iter([]), False)) == []


def test_blocks_are_packed_for_the_writer():
    """The writer of more than 200 parts holds what a task sends in memory: 40 bytes for an occurrence with its counts."""
    rng = np.random.default_rng(5)
    word = rng.zipf(1.3, 200_000) % 30_000 * np.int64(7046029254386353131)
    context = rng.integers(-(1 << 62), 1 << 62, len(word))
    context[:20_000], word[:20_000] = context[20_000:40_000], word[20_000:40_000]  # these stand twice
    context[:300], word[:300] = 3, word[0]  # and these 300 times
    rows = pa.record_batch({"word": word, "context": context, "pattern": np.where(rng.random(len(word)) < 0.2, ~word, word), "held": (rng.random(len(word)) < 0.08).astype(np.int64)})

    def by_part(blocks):
        return [(p, sorted(zip(*x, strict=True))) for b in blocks for p, *x in zip(*(b[c].to_pylist() for c in ("part", "word", "context", "pattern", "n", "held")), strict=True)]

    for held in (True, False):
        blocks = list(R._blocks(iter([rows if held else rows.drop_columns(["held"])]), 300))
        packed = list(R._packed(iter(blocks)))
        assert sum(b.nbytes for b in packed) < 0.45 * sum(b.nbytes for b in blocks) and packed[0].num_rows == blocks[0].num_rows
        back = list(R._unpacked(iter(packed)))
        assert back[0].schema.names == blocks[0].schema.names and _shapes(R._shape_batches(iter(back), held)) == _shapes(R._shape_batches(iter(blocks), held))
        if held:
            assert by_part(back) == by_part(blocks) and max(back[0]["n"].flatten().to_pylist()) > 100
    assert list(R._packed(iter([]))) == list(R._unpacked(iter([]))) == []


def test_identity_lowers_a_word_once_for_each_branch(spark):
    """Lambdas evaluate every mention, of which there were four."""
    words = ["ABC", "Émile", "straße", "İx", "\u212aelvin", "", "ÀÿŸ9", None, "ﬁN"]  # a Kelvin sign is lowered to ASCII
    rows = spark.createDataFrame([(w,) for w in words], "t string")
    own, low = F.transform(F.array("t"), chars.fold_latin)[0], F.lower("t")
    before = F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, chars.ACCENTED, chars.PLAIN))
    assert all(r.a == r.b for r in rows.select(own.alias("a"), before.alias("b")).collect())
    assert plan(rows.select(chars.fold_latin(F.col("t")).alias("x"))).count("lower(") == 2


def test_blocks_of_silhouettes_grow():
    """Each row is copied once for each block, of which there were n / 2,048."""
    assert [C.silhouette_blocks(n) for n in (0, 2048, 20_000, 600_000, 3_000_000)] == [1, 1, 10, 24, 92]


def test_silhouette_of_rows_in_parts(spark):
    """More than 256 rows a block, in one block and in several, against the plain function."""
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=(700, 4)), rng.integers(0, 3, 700)
    rows = spark.createDataFrame([(int(k), int(c), v.tolist()) for k, (v, c) in enumerate(zip(x, g))], "uid long, g int, v array<double>")
    for block in (2048, 300):
        got = C.exact_silhouette(rows, "g", "v", "uid", block).first()
        assert got.n == 700 and abs(got.silhouette - C.silhouette(x, g)) < 2e-6


def test_state_keeps_contexts_as_hashes(spark, tmp_path):
    """Contexts were kept as text, and shuffled by pattern before they were shuffled by context."""
    state = ReadingState(spark, str(tmp_path / "state"))
    occ = reading._occ(spark, SF)
    state.add(occ.where("uid % 2 = 0"), "even")
    state.add(occ.where("uid % 2 = 1"), "odd")
    assert dict(state.contexts().dtypes)["left"] == "bigint"
    assert plan(R.agreement(state.contexts())).count("Exchange hashpartitioning") == 2  # by context, by word
    assert sorted(map(tuple, R.agreement(state.contexts()).collect())) == sorted(map(tuple, R.agreement(R.contexts(occ)).collect()))


def test_words_and_characters_of_codes_move_packed(spark):
    """Each word of a plan was a row of a sort and each character four bytes of another; words that the plan leaves out moved the codes of others."""
    rng = np.random.default_rng(4)
    index, plan_rows, want = [], [], {}
    for uid in range(300):
        own = np.repeat(rng.permutation(40) - 3, rng.integers(1, 9, 40)) if uid % 7 else np.array([], int)
        index.append((uid, None if uid == 5 else [int(w) for w in own]))
        held = {int(w): (int(rng.integers(1, 4)), int(rng.integers(0, 5))) for w in rng.permutation(38)[: uid % 30]}
        plan_rows += [(uid, w, *x) for w, x in held.items()]
        want[uid] = None if uid == 5 else [held[w][1] if w in held and held[w][0] > 1 else 9 for w in own]
    rng.shuffle(plan_rows)
    indexed = spark.createDataFrame(index, "uid long, word_index array<int>")
    given = spark.createDataFrame([tuple(map(int, r)) for r in plan_rows], "uid int, idx long, n_codes int, code int")
    got = B.plan_char_codes(given, indexed, 9)
    assert {r.uid: r.codes for r in got.collect()} == want
    assert "partial_collect_list(part" in plan(got) and "MapInArrow _plan_parts" in plan(got)
    texts = pa.record_batch({"uid": [1, 2], "word_index": pa.array([np.repeat(np.arange(5000), 6), np.full(30_000, -1)], pa.list_(pa.int32()))})
    runs = next(B._index_runs(iter([texts])))
    assert runs.nbytes < texts.nbytes / 50
    assert [b.num_rows for b in B._coded(iter([runs.append_column("parts", pa.nulls(2, pa.list_(B._PART)))]), 9)] == [2]


def test_words_of_few_texts_are_held_at_once(spark):
    """A worker held spans and numbers of all texts of an Arrow batch."""
    docs = spark.createDataFrame([(1, "a bé  x9."), (2, None), (3, ""), (4, "𝒳y z𝒳 ﬁ"), (5, "..")], "uid long, text string")
    want = docs.withColumn("spans", chars.word_spans("text")).select("uid", "spans", vocab.word_index(F.col("text"), F.col("spans")).alias("word_index"))
    got = chars.with_word_spans(docs).join(chars.with_word_numbers(docs), "uid")
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect()) and got.count() == 5
    long = spark.range(9, numPartitions=1).select("id", F.repeat(F.lit("ab "), 200_000).alias("text"))
    assert chars.with_word_numbers(long).where("size(word_index) = 600000").count() == 9
    made = []
    chars._in_slices(type("D", (), {"schema": long.schema, "mapInArrow": lambda self, run, schema: made.append(run)})(), "text", "n", chars._numbers, "array<int>")
    batch = pa.record_batch({"id": list(range(9)), "text": ["ab " * 200_000] * 9})
    assert [b.num_rows for b in made[0](iter([batch]))] == [1] * 9


def test_state_deals_contexts_once(spark, tmp_path, monkeypatch):
    """Contexts were shuffled again, as text, for each compaction and lexicon; tables of other numbers of parts meet part by part."""
    monkeypatch.setattr(reading_state, "ROWS_PER_PART", 20)
    docs = spark.range(120).selectExpr("id as uid", "concat_ws(' ', 'the', if(id % 3 = 0, 'Lead', 'lead'), if(id % 3 = 0, 'pipe', 'on'), concat('w', id % 9), if(id % 2 = 0, 'Rose', 'rose'), concat('x', id % 4)) as text")
    texts = lambda by: R.Texts(docs.where(by), F.split("text", " "), F.lower)
    whole = texts("true").occurrences()
    want = sorted(map(tuple, R.mine(whole).collect()))
    state = ReadingState(spark, str(tmp_path / "state"))
    state.add(texts("uid < 30"), "few")
    state.add(texts("uid >= 30").occurrences(), "many")  # rows and texts give the same contexts
    assert sorted(state._dealt().values()) == [16, 32]
    got = state.lexicon()
    assert sorted(map(tuple, got.select("word", "code", "pattern", "n", "example", "total").collect())) == want and len(want) > 10
    exact = sorted(map(tuple, R.agreement(R.contexts(whole)).collect()))
    assert sorted(map(tuple, R.agreement(state.contexts()).collect())) == exact
    assert "Exchange" not in plan(state._by_part(64, R.shapes_of, f"word long, shape {R._shape()}, contexts long"))
    state.compact()
    assert list(state._dealt().values()) == [64] and sorted(map(tuple, R.agreement(state.contexts()).collect())) == exact
    rows = spark.read.parquet(*state._dealt())
    assert rows.count() == R.contexts(whole).count() == rows.select("word", "pattern", "context").distinct().count()
    assert sorted(map(tuple, state.lexicon().collect())) == want


def test_contexts_of_the_state_take_little_room(spark, tmp_path):
    """A row took its word and pattern as text and 12 bytes of hashes, and as much again in each shuffle."""
    rng = np.random.default_rng(2)
    word, context = rng.zipf(1.4, 300_000) % 9_000 * np.int64(7046029254386353131), rng.integers(-(1 << 62), 1 << 62, 300_000)
    rows = pa.table({"word": word, "context": context, "pattern": word}).to_batches(max_chunksize=10_000)
    counted = list(R.counts_of(iter(rows), 8))
    assert sum(b.num_rows for b in counted) == 300_000 and set(np.concatenate([b["part"].to_numpy() for b in counted])) == set(range(8))
    ReadingState(spark, str(tmp_path))._write_contexts(spark.createDataFrame(pa.Table.from_batches(counted)).coalesce(1), "t", 8)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 10 * 300_000
    lost = np.unique(word)[:5]
    left = np.concatenate([b["word"].to_numpy() for b in R.counts_of(iter(rows), 8, lost)])
    assert len(left) == (~np.isin(word, lost)).sum() < 300_000 and not np.isin(left, lost).any()
