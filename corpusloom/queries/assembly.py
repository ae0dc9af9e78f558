"""Rows put together for training, alignments, slices and keys over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, vocab
from ..operators import batching as B
from ..operators import features as X
from ..operators import manifest as M
from ..operators import sequences as S
from ..session import read_table
from ..sources import sinks
from .reading import _GUESS, _accuracy, _guesses, _sql


def alignment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as a manifest, lines as aligned words with times of four digits; orders without lines are left out."""
    start = F.col("l_quantity") / 7
    spans = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("word_index"), F.col("l_returnflag").alias("word"),
        start.alias("start"), (start + F.col("l_linenumber") / 11).alias("end"), F.col("l_discount").alias("score"),
    )
    manifest = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("speaker"))
    return X.aligned_words(manifest, sinks.alignment_rows(spans))


_ALIGN = """select l_orderkey as uid, o_orderpriority as speaker, l_linenumber as word_index, l_returnflag as word, round(l_quantity / 7, 4) as start,
round(l_quantity / 7 + l_linenumber / 11, 4) as "end", round(l_discount, 4) as score from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'"""


def ragged_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of the buffer of all embeddings' values, 64 for each; every fifth slice is empty."""
    rows = read_table(spark, sf_dir, "embeddings")
    buffer = rows.select("vec_id", F.posexplode("embedding").alias("i", "value")).select((F.col("vec_id") * 64 + F.col("i")).alias("pos"), "value")
    offsets = rows.select("vec_id", (F.col("vec_id") * 64 + F.col("label") % 8).alias("start"), (F.col("vec_id") % 5).cast("int").alias("length"))
    got = B.ragged_slices(buffer, offsets, "vec_id")
    return got.select("vec_id", F.size("values").alias("n"), F.array_join(F.transform("values", lambda v: F.floor(v * 1000).cast("string")), ",").alias("values"))


_SLICES = """with s as (select vec_id, list_slice(embedding, label % 8 + 1, label % 8 + vec_id % 5) as v from embeddings)
select vec_id, len(v)::int as n, coalesce(array_to_string([floor(x * 1000::float)::bigint::varchar for x in v], ','), '') as values from s"""


def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of labelled positions: order and line joined by a tab."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 4).alias("code"))
    return sinks.label_keys(rows)


def plan_char_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the words of documents, by their lengths, on characters: how many characters have one, their sum and the last."""
    docs = read_table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("uid"), "text")
    n = F.length("s.word")
    plan = chars.with_word_spans(docs).select("uid", F.posexplode_outer("spans").alias("idx", "s")).select("uid", "idx", (n % 3 + 1).alias("n_codes"), (n % 5).alias("code"))
    got = B.plan_char_codes(plan, chars.with_word_numbers(docs), 9)
    total = F.aggregate("coded", F.lit(0).cast("long"), lambda acc, c: acc + c)
    got = got.select("*", F.filter("codes", lambda c: c < 9).alias("coded"))
    return got.select("uid", F.size("codes").alias("n"), F.size("coded").alias("n_coded"), total.alias("total"), F.element_at("codes", -1).alias("last"))


_PLAN_CODES = """with d as (select doc_id, length(text) as n, regexp_extract_all(text, '[\\p{L}\\p{N}]+') as ws, regexp_matches(text, '[\\p{L}\\p{N}]$') as inside from documents where text <> ''),
w as (select doc_id, n, [length(w) for w in ws if length(w) % 3 > 0] as ks, case when inside and length(ws[-1]) % 3 > 0 then length(ws[-1]) % 5 else 9 end as last from d)
select doc_id as uid, n, coalesce(list_sum(ks), 0)::int as n_coded, coalesce(list_sum([k * (k % 5) for k in ks]), 0)::bigint as total, last from w"""


def row_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by the code points of turns; those of odd turns are one short, so they are not taken."""
    turns = read_table(spark, sf_dir, "conversations").where("text <> ''")
    each = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: (F.ascii(c) % 4).cast("int"))
    given = F.when(F.col("turn") % 2 == 0, each).otherwise(F.slice(each, F.lit(1), F.length("text") - 1))
    got = turns.select("conv_id", "turn", vocab.row_variants(F.col("text"), given).alias("v"))
    return got.select("conv_id", "turn", F.md5(F.array_join(F.col("v").cast("array<string>"), "")).alias("variants_md5"), F.size("v").alias("n"))


_VARIANTS = """select conv_id, turn, md5('0' || case when turn % 2 = 0 then array_to_string([(unicode(c) % 4)::varchar for c in string_split(text, '')], '') else repeat('0', length(text)) end || '0') as variants_md5,
(length(text) + 2)::int as n from conversations where text <> ''"""


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial run's rows: the first thousand orders by key."""
    return M.first_rows(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000)


def frame_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in frames as seconds; an order's lines are its frames, its price its length. Recordings without length give nulls."""
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("frames"), F.sum(F.round("l_quantity").cast("long")).alias("s"))
    length = F.when(F.col("l_orderkey") % 4 == 0, F.lit(0.0)).otherwise(F.col("s") / 10)
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0.5).alias("score")), F.struct(F.lit(1).alias("start"), F.col("frames").cast("int").alias("end"), F.lit(0.25).alias("score")))
    got = rows.select("l_orderkey", F.posexplode_outer(S.frames_to_seconds(spans, F.col("frames"), length)).alias("i", "t"))
    return got.select("l_orderkey", "i", F.round("t.start", 6).alias("start"), F.round("t.end", 6).alias("end"))


def greedy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without temperature each event type draws its most frequent item."""
    rows = read_table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 97).alias("item")).agg(F.count("*").alias("share"))
    return X.draw(rows, "event_type", "item", "share", temperature=0)


def word_means_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of three words of each order; a word without lines has the mean 0."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 4 - 1).alias("word"), "l_quantity")
    words = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("word"))
    return B.chars_to_words(rows, "l_orderkey", "word", "l_quantity", words).select("l_orderkey", "word", F.round("mean", 6).alias("mean"), "n")


def accuracy_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the neighbour classifier over all words, and by their number of codes."""
    per = _guesses(spark, sf_dir).rollup("n_codes").agg(*_accuracy())
    return per.select(F.coalesce(F.col("n_codes").cast("string"), F.lit("all")).alias("codes"), "n", "accuracy")


QUERIES = {
    "alignment_words": (alignment_words, _ALIGN),
    "ragged_slices": (ragged_slices, _SLICES),
    "label_keys": (label_keys, "select l_orderkey::varchar || chr(9) || l_linenumber::varchar as key, l_partkey % 4 as code from lineitem"),
    "plan_char_codes": (plan_char_codes, _PLAN_CODES),
    "row_variants": (row_variants, _VARIANTS),
    "first_orders": (first_orders, "select o_orderkey, o_custkey from orders order by o_orderkey limit 1000"),
    "frame_seconds": (frame_seconds, """with r as (select l_orderkey, count(*) as frames, case when l_orderkey % 4 = 0 then 0 else sum(round(l_quantity)::bigint) / 10 end as s from lineitem group by 1),
p as (select l_orderkey, case when s > 0 then frames / s end as rate, frames, unnest([0, 1]) as i from r) select l_orderkey, i, round(i / rate, 6) as start, round(case i when 0 then 1 else frames end / rate, 6) as "end" from p"""),
    "greedy_items": (greedy_items, "with w as (select event_type, user_id % 97 as item, count(*) as n from events group by all) select event_type, item from w qualify row_number() over (partition by event_type order by n desc, item) = 1"),
    "word_means_or_zero": (word_means_or_zero, "with o as (select o_orderkey as l_orderkey, unnest([0, 1, 2]) as word from orders) select o.l_orderkey, word, coalesce(round(avg(l_quantity), 6), 0) as mean, count(l_quantity) as n from o left join lineitem l on l.l_orderkey = o.l_orderkey and l_linenumber % 4 - 1 = word group by all"),
    "accuracy_overall": (accuracy_overall, _sql(_GUESS + " select coalesce(n_codes::varchar, 'all') as codes, count(*) as n, round(avg(coalesce(pattern = guess, false)::int), 6) as accuracy from g group by rollup (n_codes)")),
}
