"""Manifest, batching, sequence and numeric operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chars
from ..operators import batching as B
from ..operators import manifest as M
from ..operators import numeric as N
from ..operators import sequences as S
from ..session import read_table

_LIMITS = M.Limits(min_duration=1.0, max_duration=200.0, max_chars=8000, max_words=1200)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest: source as path, characters / 20 as seconds, no path for one source."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.when(F.col("source") == "src7", "").otherwise(F.col("source"))
    reason = M.skip_reason(path, F.col("source") == "src8", F.col("text"), F.col("n_chars") / 20, F.size(chars.words(F.col("text"))), _LIMITS)
    return docs.select("doc_id", (F.col("n_chars") / 20).alias("duration"), reason.alias("skip_reason"))


_MAN = """man as (select doc_id, n_chars / 20 as duration, case when source = 'src7' then 'no_path' when source = 'src8' then 'missing_audio' when coalesce(text, '') = '' then 'empty_text' when length(text) > 8000 then 'too_long_text'
when n_chars / 20 not between 1 and 200 then 'duration' when len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) = 0 or len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) > 1200 then 'word_count' end as skip_reason from documents)"""


def manifest_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.skip_report(_manifest(spark, sf_dir))


def manifest_kept_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kept_fraction(_manifest(spark, sf_dir))


def manifest_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median and greatest duration of the rows that are kept and of those that aren't."""
    got = _manifest(spark, sf_dir).groupBy(F.col("skip_reason").isNull().alias("kept"))
    return got.agg(F.min("duration").alias("low"), F.median("duration").alias("mid"), F.max("duration").alias("high"))


def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.assign_splits(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


_ASSIGN = """n as (select count(*) as n from documents), h as (select doc_id, row_number() over (order by md5('1234' || doc_id), doc_id::varchar) as k from documents),
sp as (select doc_id, case when k <= greatest(1, floor(0.04 * n)) then 'dev' when k <= 2 * greatest(1, floor(0.04 * n)) then 'test' else 'train' end as split from h, n)"""


def split_hours_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 20).alias("duration"))
    return M.split_report(M.assign_splits(docs, "doc_id"))


def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return M.keep_splits(M.assign_splits(docs, "doc_id"), "dev")


def occurrence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    return M.capped(events, "event_type", "event_id", 600)


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select((F.col("n_chars") / 20).cast("int").alias("len"))
    return B.batch_counts(docs, "len", 32)


_BUCKET = "(case when %s >= 32 then 1 else 0 end + case when %s >= 64 then 1 else 0 end + case when %s >= 96 then 1 else 0 end + case when %s >= 128 then 1 else 0 end + case when %s >= 160 then 1 else 0 end + case when %s >= 200 then 1 else 0 end + case when %s >= 240 then 1 else 0 end)".replace("%s", "(n_chars // 20)")


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 20).alias("len"))
    return B.batch_plan(docs, "doc_id", "len", 32)


_PLAN = f"""bk as (select doc_id, n_chars // 20 as len, {_BUCKET} as bucket from documents),
pl as (select doc_id, len, bucket, (row_number() over (partition by bucket order by md5('1234:0:' || doc_id), doc_id) - 1) as k from bk)"""


def padding_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 20).alias("len"))
    return B.padding_waste(B.batch_plan(docs, "doc_id", "len", 32), docs, "doc_id", "len")


def ragged_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ragged_offsets(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")


def collate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.transform(chars.words(F.col("text")), lambda w: F.length(w)).alias("values"))
    plan = B.batch_plan(docs.withColumn("len", F.size("values")), "doc_id", "len", 8)
    got = B.collate(docs, "doc_id", "values", plan)
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    return got.select("doc_id", "bucket", "batch", digest("padded").alias("padded_md5"), digest("mask").alias("mask_md5"))


_COLLATE = """with v as (select doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda w: length(w)) as vs from documents), n as (select *, len(vs) as n from v),
b as (select *, (case when n >= 32 then 1 else 0 end + case when n >= 64 then 1 else 0 end + case when n >= 96 then 1 else 0 end + case when n >= 128 then 1 else 0 end + case when n >= 160 then 1 else 0 end + case when n >= 200 then 1 else 0 end + case when n >= 240 then 1 else 0 end) as bucket from n),
k as (select *, (row_number() over (partition by bucket order by md5('1234:0:' || doc_id), doc_id) - 1) // 8 as batch from b), m as (select *, max(n) over (partition by bucket, batch) as top from k)
select doc_id, bucket, batch, md5(array_to_string(list_concat(vs, list_transform(range(top - n), lambda x: 0)), ',')) as padded_md5, md5(array_to_string(list_concat(list_transform(range(n), lambda x: 1), list_transform(range(top - n), lambda x: 0)), ',')) as mask_md5 from m"""


def words_to_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each character of a text the length of its word, 0 outside of words: how many values, and their digest."""
    from ..functions.vocab import word_index

    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text", chars.word_spans(F.col("text")).alias("spans"))
    rows = rows.where(F.length("text") > 0).select("doc_id", word_index(F.col("text"), F.col("spans")).alias("w"), F.transform("spans", lambda s: F.length(s["word"])).alias("v"))
    rows = rows.select("doc_id", B.words_to_chars(F.col("w"), F.col("v"), F.lit(0)).alias("values"))
    return rows.select("doc_id", F.size("values").cast("long").alias("n"), F.md5(F.array_join(F.col("values").cast("array<string>"), ",")).alias("values_md5"))


def repetition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return S.repetition_guard(events, "user_id", ["ts", "event_id"], "event_type", 6, 3).select("event_id", "banned")


def end_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return S.end_of_run(events, "user_id", ["ts", "event_id"], "event_type", 3, 2).select("event_id", "ended")


def topk_nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = read_table(spark, sf_dir, "events").where("value > 0").groupBy("event_type", (F.col("user_id") % 97).alias("item")).agg(F.sum(F.round("value", 2).cast("decimal(18,2)")).alias("d")).select("event_type", "item", F.col("d").cast("double").alias("w"))
    return S.nucleus(weights, "event_type", "item", "w", 20, 0.8).select("event_type", "item", F.round("share", 6).alias("share"))


def span_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a user's events in days as spans of words."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gaps = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts", "value")
    gaps = gaps.select(F.lit(0.0).alias("start"), ((F.col("us") - F.lag("us").over(w)) / 86400e6).alias("end"), (-F.col("value") / 10).alias("score")).where("end is not null")
    return S.drop_rate(S.span_filter(gaps))


def word_spans_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.pmod(F.col("l_linenumber"), F.lit(3)).alias("word"), F.when(F.col("l_quantity") < 5, -1.0).otherwise(F.col("l_quantity")).alias("start"), (F.col("l_quantity") + 1).alias("end"), (-F.col("l_discount")).alias("score"))
    return S.word_spans(lines, ["l_orderkey", "word"]).select("l_orderkey", "word", "start", "end", F.round("score", 6).alias("score"), "n_chars")


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_checkpoints(read_table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


def metric_means_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return read_table(spark, sf_dir, "events").select("event_type", x.alias("x")).groupBy("event_type").agg(F.round(N.finite_mean(F.col("x")), 6).alias("mean"))


def token_alignment_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against themselves in capitals, with a word changed in each third turn: aligned tokens by folded identity."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", chars.split_spaces(F.col("text")).alias("a"))
    marked = F.transform("a", lambda w, i: F.when((F.col("turn") % 3 == 0) & (i == 1), "###").otherwise(F.translate(w, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    got = turns.select("conv_id", "turn", "a", S.align_tokens(F.col("a"), marked, chars.fold_latin).alias("m"))
    return got.select("conv_id", "turn", F.size("a").alias("n"), F.size(F.filter("m", lambda x: x.isNull())).alias("n_unmatched"))


def centroid_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return N.centroids(rows, "label", "embedding", 64).select("label", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x * x), 6).alias("norm2"))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return N.nearest(rows, "vec_id", "embedding", N.centroids(rows, "label", "embedding", 64), "label").select("vec_id", "nearest", F.round("d2", 5).alias("d2"))


_CEN = """e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), c as (select label, i, avg(x) as m from e group by all)"""


def nearest_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    got = N.nearest(rows, "vec_id", "embedding", N.centroids(rows, "label", "embedding", 64), "label").join(rows.select("vec_id", "label"), "vec_id")
    cells = got.groupBy("nearest", "label").agg(F.count("*").alias("c")).groupBy("nearest").agg(F.max("c").alias("best"), F.sum("c").alias("n"))
    return cells.select("nearest", "n", F.round(F.col("best") / F.col("n"), 6).alias("purity"))


def cluster_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.cluster_separation(read_table(spark, sf_dir, "embeddings"), "label", "embedding", 64)


def fowlkes_mallows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.fowlkes_mallows(read_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def variance_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.variance_explained(read_table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


def relabel_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.relabel_by_frequency(read_table(spark, sf_dir, "documents"), "lang")


def l2_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = N.l2_normalize(F.col("embedding"))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(unit, F.lit(0)), 6).alias("first"), F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


def standardized_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.standardize(read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("z", 6).alias("z"))


def _difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each user's event types."""
    counts = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    per = counts.groupBy("user_id").agg(F.array_sort(F.collect_list("n")).alias("ns"), F.sum("n").alias("total"))  # five event types at most
    p = F.transform("ns", lambda n: n / F.col("total"))
    return per.select("user_id", N.entropy(p, F.size("ns")).alias("d"), F.size("ns").alias("k"))


_DIFF = "cn as (select user_id, event_type, count(*) as n from events group by all), pr as (select user_id, n / sum(n) over (partition by user_id) as p, count(*) over (partition by user_id) as k from cn), df as (select user_id, k, case when k <= 1 then 0 else -sum(p * ln(p)) / ln(k) end as d from pr group by user_id, k)"


def entropy_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difficulty(spark, sf_dir).select("user_id", "k", F.round("d", 6).alias("d"))


def pooled_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difficulty(spark, sf_dir).groupBy("k").agg(F.round(N.pooled_difficulty(F.col("d")), 6).alias("pooled"))


def depth_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difficulty(spark, sf_dir).groupBy(N.depth_for(F.round("d", 6), low=0.6, high=0.9).alias("depth")).agg(F.count("*").alias("n"))


def budget_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with a budget by quantity and a depth by line number."""
    rows = read_table(spark, sf_dir, "lineitem")
    depth = F.element_at(F.array(*[F.lit(x) for x in (3, 5, 8)]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return rows.select("l_orderkey", "l_linenumber", N.budget_depth(depth, F.col("l_quantity") / 50).alias("allowed"))


def difficulty_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difficulty(spark, sf_dir).agg(F.round(N.guarded_correlation("d", "k"), 6).alias("r"))


def softmax_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 10)
    got = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.masked_softmax(logits, F.lit(1) + F.col("l_linenumber") % 3).alias("p"))
    return got.select("l_orderkey", "l_linenumber", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at each event, its id as the step."""
    return read_table(spark, sf_dir, "events").select("event_id", F.round(N.learning_rate(F.col("event_id"), 0.0003, 200, 1500), 9).alias("rate"))


def alignment_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of orders as frames, parts as tokens."""
    bias = N.alignment_prior(F.col("l_linenumber") - 1, 7, F.col("l_partkey") % 15, 15)
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(bias, 6).alias("bias"))


def duration_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = N.duration_bounds(F.col("l_quantity"), F.lit(1.0) + F.col("l_discount"))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", low.alias("low"), high.alias("high"))


def labels_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label, -1 without one."""
    docs, lab = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


def labelled_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, lab = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def first_document_with_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark text's first word, the first document that holds it."""
    want = read_table(spark, sf_dir, "benchmark").select(F.get(chars.words(F.col("text")), F.lit(0)).alias("word")).distinct()
    words = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(chars.words(F.col("text")))).alias("word"))
    return words.join(want, "word").groupBy("word").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"))


def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of splits one after the other; a row's own split wins over its table's name."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "own").alias("split"))
    parts = [docs.where(F.col("doc_id") % 3 == i).withColumn("split", F.coalesce("split", F.lit(name))) for i, name in enumerate(("train", "dev", "test"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count("*").alias("n"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents by hash."""
    return read_table(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("0"), F.col("doc_id").cast("string"))), "doc_id").limit(8)


_TOPW = "select event_type, user_id % 97 as item, sum(round(value, 2)::decimal(18,2))::double as w from events where value > 0 group by all"
QUERIES = {
    "manifest_skip_reasons": (manifest_skip_reasons, f"with {_MAN} select skip_reason, count(*) as n from man where skip_reason is not null group by 1"),
    "manifest_kept_fraction": (manifest_kept_fraction, f"with {_MAN}, r as (select skip_reason, count(*) as c from man group by 1) select sum(c)::bigint as n, coalesce(sum(c) filter (skip_reason is null), 0)::bigint as n_kept, round(coalesce(sum(c) filter (skip_reason is null), 0) / sum(c), 6) as kept, case when coalesce(sum(c) filter (skip_reason is null), 0) / sum(c) < 0.9 then (select skip_reason from r where skip_reason is not null order by c desc, skip_reason desc limit 1) end as worst from r"),
    "manifest_durations": (manifest_durations, f"with {_MAN} select skip_reason is null as kept, min(duration) as low, median(duration) as mid, max(duration) as high from man group by 1"),
    "split_assign": (split_assign, f"with {_ASSIGN} select * from sp"),
    "split_hours_rollup": (split_hours_rollup, f"with {_ASSIGN} select coalesce(split, 'TOTAL') as split, count(*) as n, round(sum(n_chars / 20) / 3600, 6) as hours from sp join documents using (doc_id) group by rollup (split)"),
    "split_filter": (split_filter, f"with {_ASSIGN} select doc_id, lang, split from sp join documents using (doc_id) where split = 'dev'"),
    "occurrence_cap": (occurrence_cap, "select event_id, event_type from events qualify row_number() over (partition by event_type order by md5('1234' || event_id), event_id) <= 600"),
    "length_buckets": (length_buckets, f"with b as (select {_BUCKET} as bucket from documents) select bucket, count(*) as n, ceil(count(*) / 32)::bigint as batches, count(*) // 32 as full_batches from b group by 1"),
    "batch_plan": (batch_plan, f"with {_PLAN} select doc_id, bucket, k // 32 as batch, k % 32 as slot from pl"),
    "padding_waste": (padding_waste, f"with {_PLAN}, b as (select bucket, k // 32 as batch, max(len) as m, count(*) as n, sum(len) as s from pl group by all) select sum(m * n)::bigint as cells, round((sum(m * n) - sum(s)) / sum(m * n), 6) as waste from b"),
    "ragged_offsets": (ragged_offsets, "select doc_id, coalesce(sum(n_chars) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start, n_chars as length from documents"),
    "collate_batches": (collate_batches, _COLLATE),
    "words_to_chars": (words_to_chars, """with c as (select doc_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as pos from documents where text <> ''),
m as (select doc_id, pos, regexp_matches(ch, '[\\p{L}\\p{N}]') as w from c), g as (select *, sum((not w)::int) over (partition by doc_id order by pos) as run from m),
v as (select doc_id, pos, case when w then sum(w::int) over (partition by doc_id, run) else 0 end as value from g)
select doc_id, count(*) as n, md5(string_agg(value::bigint::varchar, ',' order by pos)) as values_md5 from v group by doc_id"""),
    "repetition_guard": (repetition_guard, "with p as (select event_id, event_type, list(event_type) over (partition by user_id order by ts, event_id rows between 6 preceding and 1 preceding) as l from events) select event_id, coalesce(len(l), 0) = 6 and len(list_filter(l, lambda x: x = event_type)) >= 3 as banned from p"),
    "end_of_run": (end_of_run, "with p as (select event_id, user_id, ts, event_type = lag(event_type) over w and event_type = lag(event_type, 2) over w and row_number() over w >= 2 as s from events window w as (partition by user_id order by ts, event_id)) select event_id, bool_or(coalesce(s, false)) over (partition by user_id order by ts, event_id) as ended from p"),
    "topk_nucleus": (topk_nucleus, f"with w as ({_TOPW}), k as (select * from w qualify rank() over (partition by event_type order by w desc) <= 20), p as (select *, w / sum(w) over (partition by event_type) as p from k), b as (select *, sum(p) over (partition by event_type order by w desc, item) - p as before from p), f as (select * from b where before <= 0.8) select event_type, item, round(p / sum(p) over (partition by event_type), 6) as share from f"),
    "span_filter_report": (span_filter_report, "with g as (select (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 86400e6 as d, -value / 10 as score from events), f as (select d between 0.04 and 2.5 and score >= -6.5 as kept from g where d is not null) select count_if(kept) as n_kept, count_if(not kept) as n_dropped, round(100 * count_if(not kept) / greatest(count(*), 1), 6) as percent from f"),
    "word_spans_rollup": (word_spans_rollup, 'select l_orderkey, l_linenumber % 3 as word, min(l_quantity) as start, max(l_quantity + 1) as "end", round(avg(-l_discount), 6) as score, count(*) as n_chars from lineitem where l_quantity >= 5 group by all'),
    "best_checkpoint": (best_checkpoint, "with r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id desc) <= 3 as recent, row_number() over (partition by user_id order by value, event_id) = 1 as best from events) select * from r where recent or best"),
    "metric_means_finite": (metric_means_finite, "select event_type, round(avg(value) filter (event_id % 7 <> 0 and event_id % 11 <> 0), 6) as mean from events group by 1"),
    "token_alignment_equal": (token_alignment_equal, f"with t as (select conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as a from conversations) select conv_id, turn, len(a) as n, case when turn % 3 = 0 and len(a) > 1 and translate(lower(a[2]), '{chars.ACCENTED}', '{chars.PLAIN}') <> '###' then 1 else 0 end as n_unmatched from t"),
    "centroid_sizes": (centroid_sizes, f"with {_CEN}, n as (select label, count(*) as n from embeddings group by 1) select label, n, round(sum(m * m), 6) as norm2 from c join n using (label) group by all"),
    "nearest_centroid": (nearest_centroid, f"with {_CEN}, d as (select e.vec_id, c.label, sum((x - m) * (x - m)) as d2 from e join c using (i) group by all) select vec_id, label as nearest, round(d2, 5) as d2 from d qualify row_number() over (partition by vec_id order by d2, label) = 1"),
    "nearest_purity": (nearest_purity, f"with {_CEN}, d as (select e.vec_id, e.label as own, c.label, sum((x - m) * (x - m)) as d2 from e join c using (i) group by all), b as (select * from d qualify row_number() over (partition by vec_id order by d2, label) = 1), k as (select label as nearest, own, count(*) as c from b group by all) select nearest, sum(c)::bigint as n, round(max(c) / sum(c), 6) as purity from k group by 1"),
    "cluster_separation": (cluster_separation, f"with {_CEN}, r as (select e.label, e.vec_id, sqrt(sum((x - m) * (x - m))) as r from e join c using (label, i) group by all), mr as (select avg(a) as radius from (select avg(r) as a from r group by label)), g as (select sqrt(sum((a.m - b.m) * (a.m - b.m))) as gap from c a join c b on a.i = b.i and a.label < b.label group by a.label, b.label) select round(min(gap) / (any_value(radius) + 1e-8) / 2, 6) as separation from g, mr"),
    "fowlkes_mallows": (fowlkes_mallows, "with c as (select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders group by all), t as (select sum(n * (n - 1) / 2) as tp from c), x as (select sum(n * (n - 1) / 2) as p from (select sum(n) as n from c group by a)), y as (select sum(n * (n - 1) / 2) as p from (select sum(n) as n from c group by b)) select round(tp / sqrt(x.p * y.p), 6) as score from t, x, y"),
    "variance_explained": (variance_explained, "with g as (select count(*) as n, avg(o_totalprice) as m from orders group by o_orderpriority), t as (select count(*) as n, avg(o_totalprice) as m, var_pop(o_totalprice) as v from orders) select any_value(t.n) as n, round(sum(g.n * (g.m - t.m) * (g.m - t.m)) / any_value(t.n * t.v), 6) as r2 from g, t"),
    "relabel_by_frequency": (relabel_by_frequency, "select lang, row_number() over (order by count(*) desc, lang) - 1 as code, count(*) as n from documents group by lang"),
    "l2_norms": (l2_norms, "with n as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))) + 1e-8 as n from embeddings) select vec_id, round(embedding[1]::double / n, 6) as first, round(list_sum(list_transform(embedding, lambda x: (x::double / n) * (x::double / n))), 6) as norm2 from n"),
    "standardized_prices": (standardized_prices, "with s as (select avg(p_retailprice) as m, stddev_pop(p_retailprice) + 1e-6 as s from part) select p_partkey, round((p_retailprice - m) / s, 6) as z from part, s"),
    "entropy_difficulty": (entropy_difficulty, f"with {_DIFF} select user_id, k, round(d, 6) as d from df"),
    "pooled_difficulty": (pooled_difficulty, f"with {_DIFF} select k, round(sum(exp(8 * d) * d) / greatest(sum(exp(8 * d)), 1e-9), 6) as pooled from df group by k"),
    "depth_route": (depth_route, f"with {_DIFF} select case when round(d, 6) <= 0.6 then 3 when round(d, 6) <= 0.9 then 5 else 8 end as depth, count(*) as n from df group by 1"),
    "budget_depth": (budget_depth, "with b as (select l_orderkey, l_linenumber, [3, 5, 8][(l_linenumber % 3 + 1)::int] as depth, greatest(3, round_even(l_quantity / 50 * 8, 0)::int) as ceiling from lineitem) select l_orderkey, l_linenumber, least(depth, case when ceiling >= 8 then 8 when ceiling >= 5 then 5 else 3 end) as allowed from b"),
    "difficulty_correlation": (difficulty_correlation, f"with {_DIFF} select round(coalesce(covar_pop(d, k) / nullif(case when stddev_pop(d) > 1e-6 and stddev_pop(k) > 1e-6 then stddev_pop(d) * stddev_pop(k) else 0 end, 0), 0), 6) as r from df"),
    "softmax_shares": (softmax_shares, "with e as (select l_orderkey, l_linenumber, exp(l_discount * 10) as a, case when l_linenumber % 3 >= 1 then exp(l_tax * 10) else 0 end as b, case when l_linenumber % 3 >= 2 then exp(l_quantity / 10) else 0 end as c from lineitem) select l_orderkey, l_linenumber, round(a / (a + b + c), 6) as p0, round(b / (a + b + c), 6) as p1, round(c / (a + b + c), 6) as p2 from e"),
    "lr_schedule": (lr_schedule, "select event_id, round(case when event_id < 200 then 0.0003 * (event_id + 1) / 200 when event_id >= 1500 then 0.00003 else 0.00003 + 0.5 * 0.00027 * (1 + cos(pi() * (event_id - 200) / 1300)) end, 9) as rate from events"),
    "alignment_prior": (alignment_prior, "with d as (select l_orderkey, l_linenumber, (l_linenumber - 1) / 6 - (l_partkey % 15) / 14 as d from lineitem) select l_orderkey, l_linenumber, round(-(d * d) / (2 * 0.12 * 0.12), 6) as bias from d"),
    "duration_bounds": (duration_bounds, "with e as (select l_orderkey, l_linenumber, trunc(greatest(1, l_quantity / (1 + l_discount)))::int as e from lineitem), h as (select *, greatest(8, trunc(e * 1.6::double)::int) as high from e) select l_orderkey, l_linenumber, least(greatest(4, trunc(e * 0.6::double)::int), high) as low, high from h"),
    "labels_left_join": (labels_left_join, "select doc_id, coalesce(quality, -1) as quality from documents left join labels using (doc_id)"),
    "labelled_semi": (labelled_semi, "select lang, count(*) as n, sum(n_chars)::bigint as chars from documents where doc_id in (select doc_id from labels) group by 1"),
    "first_document_with_word": (first_document_with_word, "with w as (select distinct regexp_extract_all(text, '[\\p{L}\\p{N}]+')[1] as word from benchmark), d as (select distinct doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) as word from documents) select word, min(doc_id) as doc_id, count(*) as n_docs from d join w using (word) group by word"),
    "union_splits": (union_splits, "select case when doc_id % 5 = 0 then 'own' else ['train', 'dev', 'test'][doc_id % 3 + 1] end as split, count(*) as n from documents group by 1"),
    "hash_sample": (hash_sample, "select doc_id from documents order by md5('0' || doc_id), doc_id limit 8"),
}
