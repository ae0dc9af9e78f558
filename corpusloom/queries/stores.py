"""Stores that tasks write and read by byte ranges: ragged buffers and recordings, filled from the embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read_table, scratch_path
from ..sources import pcm, ragged


def _total(values: Column) -> Column:
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6)


def ragged_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding's first vec_id % 60 + 4 values in a ragged store, written in two appends and read back whole through the format."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.slice("embedding", F.lit(1), (F.col("vec_id") % 60 + 4).cast("int")).alias("values"))
    path = scratch_path(spark, "ragged")
    ragged.write(rows.where("uid % 3 = 0"), path)
    ragged.write(rows.where("uid % 3 <> 0"), path)
    got = spark.read.format("ragged").load(path)
    v = F.col("values").cast("array<double>")
    return got.select("uid", F.size("values").alias("n"), F.get(v, F.lit(0)).alias("first"), F.element_at(v, -1).alias("last"), _total(v).alias("total"))


def ragged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as 16 frames of 4 values in a ragged store; of each the frames from vec_id % 13 on, five at most, by their byte range."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("embedding", t * 4 + 1, F.lit(4))).alias("values"))
    path = scratch_path(spark, "ragged")
    ragged.write(rows, path)
    got = ragged.slices(spark, path, rows.select("uid", (F.col("uid") % 13).alias("first"), F.lit(5).alias("count")))
    v = F.flatten("values").cast("array<double>")
    return got.select("uid", F.size("values").alias("n"), F.get(v, F.lit(0)).alias("first"), F.element_at(v, -1).alias("last"), _total(v).alias("total"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings in two channels: the embeddings of eight vec_ids, one after the other."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("uid"), "vec_id", "embedding")
    clips = rows.groupBy("uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("samples"))  # eight of them
    return clips.select("uid", F.transform("samples", lambda x: x.cast("double") / 8).alias("samples"), F.lit(2).alias("channels"))


def pcm_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and format of recordings written from the embeddings, from their headers alone."""
    folder = scratch_path(spark, "wavs")
    pcm.write(_clips(spark, sf_dir), folder, 8000).write.format("noop").mode("overwrite").save()
    got = pcm.read(spark, folder)
    return got.select(F.regexp_extract("path", "([0-9]+)\\.wav$", 1).cast("long").alias("uid"), "size", "rate", "channels", "bits", "frames", "seconds")


def pcm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, mean square and peak of the samples read back, both channels mixed."""
    folder = scratch_path(spark, "wavs")
    clips = materialize(pcm.write(_clips(spark, sf_dir), folder, 8000), "clips")
    got = pcm.read(spark, folder, 8000).select("path", F.col("samples").cast("array<double>").alias("s"))
    power = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    joined = got.join(clips, got.path == clips.audio_path)
    return joined.select(F.col("uid").cast("long").alias("uid"), F.size("s").cast("long").alias("frames"), F.round(power / F.size("s"), 6).alias("power"), F.round(F.array_max(F.transform("s", lambda x: F.abs(x))), 5).alias("peak"))


_VALUES = "unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i"
_PCM = f"""with v as (select vec_id, vec_id // 8 as uid, {_VALUES} from embeddings),
s as (select uid, (row_number() over (partition by uid order by vec_id, i) - 1) // 2 as t, greatest(-32768, least(32767, round_even(x / 8 * 32767, 0))) / 32768 as y from v),
f as (select uid, t, avg(y) as y from s group by all)"""

QUERIES = {
    "ragged_store": (ragged_store, f"with v as (select vec_id as uid, {_VALUES} from embeddings), k as (select * from v where i < uid % 60 + 4) select uid, count(*)::int as n, arg_min(x, i) as first, arg_max(x, i) as last, round(sum(x), 6) as total from k group by uid"),
    "ragged_ranges": (ragged_ranges, f"with v as (select vec_id as uid, {_VALUES} from embeddings), k as (select * from v where i // 4 >= uid % 13 and i // 4 < uid % 13 + 5) select uid, (count(*) // 4)::int as n, arg_min(x, i) as first, arg_max(x, i) as last, round(sum(x), 6) as total from k group by uid"),
    "pcm_headers": (pcm_headers, "select vec_id // 8 as uid, 44 + sum(len(embedding)) * 2 as size, 8000::int as rate, 2::int as channels, 16::int as bits, sum(len(embedding)) // 2 as frames, sum(len(embedding)) / 2 / 8000 as seconds from embeddings group by 1"),
    "pcm_samples": (pcm_samples, f"{_PCM} select uid, count(*) as frames, round(avg(y * y), 6) as power, round(max(abs(y)), 5) as peak from f group by uid"),
}
