"""Pooling, teachers, losses and sampling over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chars
from ..operators import batching as B
from ..operators import features as X
from ..operators import numeric as N
from ..operators import sequences as S
from ..session import read_table
from .reading import _sql, _texts
from ..operators import readings as R


def chars_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 4 - 1).alias("word"), "l_quantity")
    return B.chars_to_words(rows, "l_orderkey", "word", "l_quantity").select("l_orderkey", "word", F.round("mean", 6).alias("mean"), "n")


def span_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as utterances: lines as frames of two numbers, spans of two seconds from each odd line."""
    lines = read_table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    frames = lines.select(F.col("l_orderkey").alias("uid"), (F.row_number().over(w) - 1).alias("t"), F.array("l_quantity", F.col("l_discount") * 100).alias("vector"))
    spans = frames.where("t % 2 = 1").select("uid", F.col("t").alias("word_index"), F.col("t").cast("double").alias("start"), (F.col("t") + 1.0).alias("end"))
    got = X.span_means(frames, spans, 1.0, 0.5, 2)
    return got.select("uid", "word_index", F.round(F.get("mean", F.lit(0)), 5).alias("x"), F.round(F.get("mean", F.lit(1)), 5).alias("y"))


_SPAN = """with f as (select l_orderkey as uid, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as t, l_quantity as x, l_discount * 100 as y from lineitem),
m as (select uid, avg(x) as mx, avg(y) as my, count(*) as n from f group by uid), s as (select uid, t as w, greatest(0, floor(t - 0.5)) as a, least(n, ceil(t + 1.5)) as b from f join m using (uid) where t % 2 = 1)
select s.uid, s.w as word_index, round(avg(x - mx), 5) as x, round(avg(y - my), 5) as y from s join m using (uid) join f on f.uid = s.uid and f.t >= a and f.t < b group by s.uid, s.w"""


def path_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from the running counts of an order's lines."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"))).alias("ls"))  # the lines of one order
    path = F.transform("ls", lambda x, i: F.floor(i / 2).cast("int"))
    scores = F.transform("ls", lambda x: x["l_discount"])
    got = lines.select("l_orderkey", F.posexplode(X.spans_of_path(path, scores, F.lit(3))).alias("target", "s"))
    return got.select("l_orderkey", "target", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.round(F.when(F.col("s.start") >= 0, F.col("s.score")), 6).alias("score"))


_PATH = """with f as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount) - 1 as t, l_discount as d from lineitem), g as (select *, t // 2 as s from f),
o as (select distinct l_orderkey, unnest([0, 1, 2]) as target from lineitem)
select o.l_orderkey, o.target, coalesce(min(t), -1) as start, coalesce(max(t) + 1, -1) as "end", round(avg(d), 6) as score from o left join g on g.l_orderkey = o.l_orderkey and g.s = 2 * o.target + 1 group by all"""


def teacher_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed linear head over each embedding."""
    w = [[((i * 7 + k * 3) % 11 - 5) / 10 for i in range(64)] for k in range(3)]
    logits = X.teacher_logits(F.col("embedding").cast("array<double>"), [0.01] * 64, [2.0] * 64, w, [0.1, 0.2, 0.3])
    got = read_table(spark, sf_dir, "embeddings").select("vec_id", logits.alias("z"))
    return got.select("vec_id", *[F.round(F.get("z", F.lit(k)), 5).alias(f"z{k}") for k in range(3)])


_TEACH = "with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) select vec_id, " + ", ".join(f"round({(k + 1) / 10} + sum((x - 0.01::double) / 2 * ((i * 7 + {k * 3}) % 11 - 5) / 10), 5) as z{k}" for k in range(3)) + " from e group by vec_id"


def teacher_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of a logistic head fitted on the embeddings' labels."""
    rows = read_table(spark, sf_dir, "embeddings").select("embedding", "label", F.expr("vec_id % 4 = 0").alias("held"))
    model = X.fit_teacher(rows.where("not held"), "embedding", "label")
    from pyspark.ml.functions import array_to_vector

    held = rows.where("held").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label")
    return model.transform(held).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 4).alias("accuracy"))


def evaluation_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed cross-entropy, divergence from shifted scores, and binary loss by order line number."""
    logits = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 10)
    teacher = F.array(F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_quantity") / 20)
    rows = read_table(spark, sf_dir, "lineitem").select("l_linenumber", logits.alias("z"), teacher.alias("t"), F.pmod(F.col("l_partkey"), F.lit(3)).cast("int").alias("y"))
    rows = rows.withColumn("p", N.masked_softmax(F.col("z"), F.lit(3)))
    return rows.groupBy("l_linenumber").agg(
        F.round(F.avg(X.cross_entropy(F.col("p"), F.col("y"), F.lit(3))), 5).alias("ce"), F.round(F.avg(X.soft_divergence(F.col("z"), F.col("t"), F.lit(3))), 5).alias("kl"),
        F.round(F.avg(X.binary_cross_entropy(F.get("z", F.lit(0)), F.get("p", F.lit(0)))), 5).alias("bce"), F.round(F.avg(X.cosine_loss(F.col("z"), F.col("t"))), 5).alias("rep"),
    )


_LOSS = """with r as (select l_linenumber, l_discount * 10 as a, l_tax * 10 as b, l_quantity / 10 as c, l_quantity / 20 as d, l_partkey % 3 as y from lineitem),
s as (select *, ln(exp(a) + exp(b) + exp(c)) as z, ln(exp(a / 2) + exp(b / 2) + exp(c / 2)) as zs, ln(exp(b / 2) + exp(a / 2) + exp(d / 2)) as zt from r)
select l_linenumber, round(avg(-(0.98 * (case y when 0 then a when 1 then b else c end - z) + 0.02 * (a + b + c - 3 * z) / 3)), 5) as ce,
round(avg(4 * (exp(b / 2 - zt) * (b / 2 - zt - a / 2 + zs) + exp(a / 2 - zt) * (a / 2 - zt - b / 2 + zs) + exp(d / 2 - zt) * (d / 2 - zt - c / 2 + zs))), 5) as kl,
round(avg(greatest(a, 0) - a * exp(a - z) + ln(1 + exp(-abs(a)))), 5) as bce, round(avg(1 - (a * b + b * a + c * d) / greatest(sqrt((a * a + b * b + c * c) * (b * b + a * a + d * d)), 1e-8)), 5) as rep from s group by 1"""


def sampled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw for each event type from its nucleus."""
    weights = read_table(spark, sf_dir, "events").where("value > 0").groupBy("event_type", (F.col("user_id") % 97).alias("item")).agg(F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double").alias("w"))
    return X.draw(S.nucleus(weights, "event_type", "item", "w", 20, 0.8), "event_type", "item", "share")


def guarded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the words of the first benchmark texts, those that the lexicon calls ambiguous."""
    want = read_table(spark, sf_dir, "benchmark").select(F.explode(chars.words(F.col("text"))).alias("t")).select(chars.fold_latin(F.col("t")).alias("word")).distinct()
    lex = R.mine(_texts(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n_codes")).where("n_codes > 1")
    return lex.join(want, "word", "left_semi")


def probe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of segment and brand names, sorted."""
    parts = read_table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).where("word <> '' and word <> 'NONE'")
    return parts.distinct().orderBy("word")


def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("median"), F.count("*").alias("n"))


_SAMPLED = """with w as (select event_type, user_id % 97 as item, sum(round(value, 2)::decimal(18, 2))::double as w from events where value > 0 group by all),
k as (select * from w qualify rank() over (partition by event_type order by w desc) <= 20), p as (select *, w / sum(w) over (partition by event_type) as p from k),
b as (select *, sum(p) over (partition by event_type order by w desc, item) - p as before from p), f as (select event_type, item, p / sum(p) over (partition by event_type) as share from b where before <= 0.8),
c as (select *, sum(share) over (partition by event_type order by share desc, item rows unbounded preceding) as upto, sum(share) over (partition by event_type) as total,
  ('0x' || substr(md5('0:' || event_type), 1, 13))::bigint / 4503599627370496.0 as u from f)
select event_type, item from c where upto > u * total qualify row_number() over (partition by event_type order by upto, item) = 1"""

QUERIES = {
    "chars_to_words": (chars_to_words, "select l_orderkey, l_linenumber % 4 - 1 as word, round(avg(l_quantity), 6) as mean, count(*) as n from lineitem where l_linenumber % 4 >= 1 group by all"),
    "span_means": (span_means, _SPAN),
    "path_spans": (path_spans, _PATH),
    "teacher_scores": (teacher_scores, _TEACH),
    "teacher_head": (teacher_head, None),
    "evaluation_losses": (evaluation_losses, _LOSS),
    "sampled_items": (sampled_items, _SAMPLED),
    "guarded_words": (guarded_words, _sql(f", w as (select distinct translate(lower(t), '{chars.ACCENTED}', '{chars.PLAIN}') as word from (select unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) as t from benchmark)) select word, count(*) as n_codes from lex where word in (select word from w) group by word having count(*) > 1")),
    "probe_words": (probe_words, "select distinct word from (select unnest(string_split(p_type, ' ')) as word from part) where word <> '' and word <> 'NONE' order by word"),
    "median_gap": (median_gap, "select event_type, median(value) as median, count(*) as n from events group by 1"),
}
