"""Operators with rules that run in order or in numpy; rows only, except where SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chars, marks
from ..functions.verbalize import verbalized
from ..operators import cluster as C
from ..operators import alignment as A
from ..operators import sequences as S
from ..session import read_table


def verbalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their numbers, addresses and Latin words spoken in Arabic."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return verbalized(docs).select("doc_id", F.md5("text").alias("spoken_md5"), F.length("text").alias("n"))


def ctc_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of four symbols aligned with each embedding of 64 values, taken as 16 frames of scores of 4 symbols."""
    rows = read_table(spark, sf_dir, "embeddings")
    frame = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get("embedding", t * 4 + k).cast("double")))
    targets = F.array((F.col("label") % 3 + 1).cast("int"), F.lit(1), F.lit(2))
    return A.forced_align(rows.select(F.col("vec_id").alias("uid"), frame.alias("scores"), targets.alias("targets"))).select("uid", F.posexplode("spans").alias("i", "s")).select("uid", "i", "s.*")


def discover_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select((F.col("label") % 5).cast("string").alias("word"), F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"), F.lit(None).cast("double").alias("seconds"))
    return C.discover_codes(rows)


def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exact_silhouette(read_table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id")


def monotonic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a document's words in the order of their starts, moved by a hash: those that overlap the last one kept go."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", chars.word_spans(F.col("text")).alias("words"))
    moved = lambda s: F.struct((s["start"] + F.length(s["word"]) % 3).alias("start"), (s["end"] + F.length(s["word"]) % 4).alias("end"))
    docs = docs.select("doc_id", F.transform("words", moved).alias("spans"))
    return docs.select("doc_id", F.size("spans").alias("n"), F.size(S.monotonic_spans(F.col("spans"))).alias("n_kept"))


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each supplier's price series would stop improving."""
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.month("l_shipdate").alias("m"), F.year("l_shipdate").alias("y")).agg(F.avg("l_extendedprice").alias("v"))
    series = rows.groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "m", "v"))), lambda x: x["v"]).alias("vs"))  # a value for each month
    return series.select("l_suppkey", F.size("vs").alias("n"), S.early_stop(F.col("vs"), 8, 0.002).alias("stop"))


def vowel_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of words made of Arabic letters and marks from the digits of order keys."""
    letters, vowels = "ابتجحدرسعفقكلمنهوية", "َُِّْ"
    digits = F.lpad(F.col("o_orderkey").cast("string"), 6, "3")
    word = F.array_join(F.transform(F.split(digits, ""), lambda d, i: F.when(d != "", F.concat(F.substring(F.lit(letters), (d.cast("int") * 2 + i % 2 - 1).cast("int") + 1, F.lit(1)), F.substring(F.lit(vowels), (d.cast("int") % 5) + 1, F.lit(1)))).otherwise("")), "")
    got = read_table(spark, sf_dir, "orders").select("o_orderkey", word.alias("word"))
    return got.select("o_orderkey", "word", marks.vowel_pattern(F.col("word")).alias("pattern"), chars.word_identity(F.col("word")).alias("identity"), F.array_join(marks.letter_variants(F.col("word")).cast("array<string>"), "").alias("variants"))


def neighbour_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days between an order and the customer's one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = read_table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"))


_SILHOUETTE = """with e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
d as (select a.vec_id, a.label as g, b.label as o, b.vec_id as other, sqrt(sum((a.x - b.x) * (a.x - b.x))) as d from e a join e b on a.i = b.i group by all),
s as (select vec_id, g, o, sum(d) as t, count(*) as n from d group by all),
p as (select vec_id, max(case when g = o and n > 1 then t / (n - 1) end) as a, min(case when g <> o then t / n end) as b from s group by vec_id)
select count(*) as n, round(avg(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from p"""

_EARLY = """with recursive m as (select l_suppkey, year(l_shipdate) as y, month(l_shipdate) as m, avg(l_extendedprice) as v from lineitem group by all),
r as (select *, row_number() over (partition by l_suppkey order by y, m) - 1 as i, count(*) over (partition by l_suppkey) as n from m),
s as (select l_suppkey, 0::bigint as i, case when v < 'infinity'::double - 0.002 then v else 'infinity'::double end as best, (not v < 'infinity'::double - 0.002)::int as bad, -1::bigint as stop from r where i = 0
  union all
  select s.l_suppkey, s.i + 1, case when r.v < s.best - 0.002 then r.v else s.best end, case when r.v < s.best - 0.002 then 0 else s.bad + 1 end,
    case when s.stop < 0 and not r.v < s.best - 0.002 and s.bad + 1 >= 8 then s.i + 1 else s.stop end from s join r on r.l_suppkey = s.l_suppkey and r.i = s.i + 1)
select s.l_suppkey, any_value(r.n)::int as n, max(s.stop)::int as stop from s join r using (l_suppkey, i) group by s.l_suppkey"""

QUERIES = {
    "verbalize_text": (verbalize_text, None),
    "ctc_align": (ctc_align, None),
    "discover_codes": (discover_codes, None),
    "silhouette_exact": (silhouette_exact, _SILHOUETTE),
    "monotonic_spans": (monotonic_spans, None),
    "early_stop": (early_stop, _EARLY),
    "vowel_patterns": (vowel_patterns, None),
    "neighbour_gap": (neighbour_gap, "select o_orderkey, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey)::date, o_orderdate::date) as days from orders"),
}
