"""Counts of readings that grow with a stream of documents, and windowed event counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import chars
from ..operators import readings as R


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """window, event_type, n, total of events (ts, event_type, value), tumbling or sliding; events later than the watermark are dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def reading_counts(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's counts of (word, pattern) to a table, one folder for each batch, so a repeated batch writes the same folder again."""
    source = documents.select(F.col("doc_id").alias("uid"), "text")

    def add(batch: DataFrame, number: int) -> None:
        occ = R.occurrences(batch, chars.words(F.col("text")), chars.fold_latin, lambda t: t)
        occ.groupBy("word", "pattern").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("word", "pattern").agg(F.sum("n").alias("n"))
