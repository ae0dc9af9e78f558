"""Streams over the driver's tables, run until what is there is read."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reading_state
from ..session import read_table, scratch_path
from ..streaming import ordered
from .reading import QUERIES as _READING
from .reading import _texts


def stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four arrivals, a fifth of them a week late, judged by the repetition guard and the end of a run on a stream."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    base = scratch_path(spark, "stream")
    first = events.agg(F.min(F.unix_seconds("ts"))).first()[0]
    week = F.floor((F.unix_seconds("ts") - first) / (8 * 86400)) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    for k in range(5):
        events.where(week == k).coalesce(2).write.mode("append").parquet(f"{base}/in")
    end = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts"))
    end.select(F.lit(-1).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"), "ts", F.lit("end").alias("event_type")).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    judged = ordered.ordered_rules(stream, "user_id", "ts", "event_id", "event_type", "20 days", 6, 3, 3, 2)
    ordered.append(judged, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "banned", "ended")


def reading_state_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading inventory from a state table to which the documents were added in three batches, the last first, compacted in between."""
    state = reading_state.ReadingState(spark, scratch_path(spark, "state"))
    texts = _texts(spark, sf_dir)
    batch = lambda k: replace(texts, sentences=texts.sentences.where(F.pmod(F.xxhash64("uid"), F.lit(3)) == k))
    for k in (2, 0):
        state.add(batch(k), f"batch-{k}")
    state.compact()
    state.add(batch(1), "batch-1")
    return state.lexicon()


_RULES = """with p as (select event_id, user_id, ts, event_type, list(event_type) over (partition by user_id order by ts, event_id rows between 6 preceding and 1 preceding) as l,
  event_type = lag(event_type) over w and event_type = lag(event_type, 2) over w and row_number() over w >= 2 as s from events window w as (partition by user_id order by ts, event_id))
select event_id, coalesce(len(l), 0) = 6 and len(list_filter(l, lambda x: x = event_type)) >= 3 as banned, bool_or(coalesce(s, false)) over (partition by user_id order by ts, event_id) as ended from p"""

QUERIES = {
    "stream_rules": (stream_rules, _RULES),
    "reading_state_inventory": (reading_state_inventory, _READING["reading_inventory"][1]),
}
