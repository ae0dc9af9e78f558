"""Interval joins, moments and projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import projection as P
from ..session import materialize, read_table


def events_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error of a user the events of that user in the hours after it, as many as the error's value says."""
    events = read_table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = events.where("event_type = 'error'").select("user_id", "event_id", F.col("us").alias("low"), (F.col("us") + F.floor(F.col("value") * 3600) * 1_000_000).alias("high"))
    points = events.select("user_id", F.col("us").alias("at"), F.col("event_id").alias("met"))
    return I.points_in_intervals(points, errors, ["user_id"], "at", "low", "high").groupBy("event_id").agg(F.count("*").alias("n"), F.min("met").alias("first"), F.max("met").alias("last"))


def char_word_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of conversation turns and the words they stand in, joined as intervals: how many are inside, and the sum of their words' numbers."""
    turns = read_table(spark, sf_dir, "conversations").where("text <> ''").select(F.concat_ws(":", "conv_id", "turn").alias("uid"), "text")
    characters = turns.select("uid", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("pos"))
    # words: runs of ASCII letters, each begins at a letter after none
    letters = F.transform(F.split("text", ""), lambda c: c.between("A", "Z") | c.between("a", "z"))
    begins = lambda ls: F.array_compact(F.transform(ls, lambda x, i: F.when(x & ~F.coalesce(F.get(ls, i - 1), F.lit(False)), i)))
    # the array around letters has them computed once, not for each letter
    starts = F.get(F.transform(F.array(letters), begins), F.lit(0))
    rows = turns.select("uid", F.arrays_zip(starts.alias("start"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("word")).alias("spans"))
    spans = rows.select("uid", F.posexplode("spans").alias("word_index", "s")).select("uid", "word_index", F.col("s.start").alias("start"), (F.col("s.start") + F.length("s.word")).alias("end"))
    spans = materialize(spans, "spans")
    got = I.char_words(characters, spans)
    inside = F.col("word_index") >= 0
    return got.groupBy("uid").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"), F.sum(F.when(inside, F.col("word_index")).otherwise(0)).alias("total"))


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The covariances of the embeddings' 64 positions, from merged shares of partitions."""
    rows = read_table(spark, sf_dir, "embeddings")
    m = P.moments(rows.repartition(40, "vec_id"), "embedding", 64)
    cells = [(i, j, float(m.scatter[i, j] / max(1, m.n))) for i in range(64) for j in range(i + 1)]
    return spark.createDataFrame(cells, "i int, j int, cov double").select("i", "j", F.round("cov", 6).alias("cov"))


def embedding_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first eight principal axes, whitened."""
    rows = read_table(spark, sf_dir, "embeddings")
    return P.project(rows, "vec_id", "embedding", P.fit(rows, "embedding", 64, 8, whiten=True))


_WINDOWS = """with e as (select user_id, event_id, epoch_us(ts) as low, epoch_us(ts) + floor(value * 3600)::bigint * 1000000 as high from events where event_type = 'error')
select e.event_id, count(*) as n, min(p.event_id) as first, max(p.event_id) as last from e join events p on p.user_id = e.user_id and epoch_us(p.ts) >= low and epoch_us(p.ts) < high group by e.event_id"""
_CHARS = """with c as (select conv_id || ':' || turn as uid, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as pos from conversations where text <> ''),
m as (select *, regexp_matches(ch, '[A-Za-z]') as w from c), s as (select *, w and not coalesce(lag(w) over (partition by uid order by pos), false) as begins from m),
k as (select *, sum(begins::int) over (partition by uid order by pos) - 1 as word from s)
select uid, count(*) as n, count_if(w) as n_inside, sum(case when w then word else 0 end)::bigint as total from k group by uid"""
_GRAM = """with v as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings)
select a.i::int as i, b.i::int as j, round(covar_pop(a.x, b.x), 6) as cov from v a join v b on a.vec_id = b.vec_id and b.i <= a.i group by a.i, b.i"""

QUERIES = {
    "events_in_windows": (events_in_windows, _WINDOWS),
    "char_word_join": (char_word_join, _CHARS),
    "gram_matrix": (gram_matrix, _GRAM),
    "embedding_projection": (embedding_projection, None),
}
