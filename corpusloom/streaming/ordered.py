"""Rules over ordered values on a stream: the repetition guard and the end of a run, with keyed state, timers and late rows.

Rows of a key wait in state until the watermark has passed them, so they are judged in the order of time and id however they
arrive; a timer stands at the earliest one that waits. The state of a key is the rows that wait, which the delay bounds, and what
the rules look back on: the last values, how many were seen, and whether a run has ended. A row that comes after its time was
judged is late and is left out. Rows that the watermark has not passed wait on; a row beyond all others by the delay (of any key,
the null key too) closes a stream that has an end.

The state survives a restart from the same checkpoint. A row is written once for each time that it is judged, which is once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rules:
    """What both rules look back on for one key; judge() takes its values one after the other."""

    def __init__(self, window: int, repeats: int, run: int, least: int, held: str | None = None):
        self.window, self.repeats, self.run, self.least = window, repeats, run, least
        self.last, self.seen, self.ended = json.loads(held) if held else ([], 0, False)

    def judge(self, value: str | None) -> tuple[bool, bool]:
        past = self.last[-self.window :] if self.window else []
        banned = value is not None and len(past) == self.window and None not in past and past.count(value) >= self.repeats
        self.seen += 1
        self.last = (self.last + [value])[-max(self.window, self.run) :]
        tail = self.last[-self.run :]
        self.ended = self.ended or (len(tail) == self.run and None not in tail and len(set(tail)) == 1 and self.seen >= self.least)
        return banned, self.ended

    def held(self) -> str:
        return json.dumps([self.last, self.seen, self.ended])


class OrderedRules(StatefulProcessor):
    def __init__(self, window: int, repeats: int, run: int, least: int):
        self.rules = (window, repeats, run, least)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, value string")
        self.past = handle.getValueState("past", "upto long, held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # no generator: what a generator does may run when the state already stands at another key
        upto = self.past.get()[0] if self.past.exists() else None
        new = [(int(us), int(i), None if pd.isna(v) else v) for part in rows for us, i, v in zip(part["us"], part["id"], part["value"], strict=True)]
        new = [r for r in new if upto is None or r[0] > upto * 1000]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= now * 1000]
        rest = rows[len(ready) :]
        if not ready:
            return
        rules = Rules(*self.rules, self.past.get()[1] if self.past.exists() else None)
        judged = [rules.judge(v) for _, _, v in ready]
        self.past.update((now, rules.held()))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
        yield pd.DataFrame({"key": [key[0]] * len(ready), "us": [r[0] for r in ready], "id": [r[1] for r in ready], "value": [r[2] for r in ready], "banned": [b for b, _ in judged], "ended": [e for _, e in judged]})

    def close(self) -> None:
        pass


def ordered_rules(rows: DataFrame, key: str, ts: str, order: str, value: str, delay: str, window: int = 12, repeats: int = 3, run: int = 8, least: int = 0) -> DataFrame:
    """key, ts, order, value, banned, ended of a stream: what repetition_guard() and end_of_run() say of each row, in the order of (ts, order).

    delay is how much later than others a row may come. Rows without a time are left out. Needs the RocksDB state store, which is set here.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = rows.schema[key].dataType.simpleString()
    # keys as text, as a null among whole numbers would make all of them floats on their way through pandas
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    at = F.col(ts).cast("timestamp")
    standard = rows.select(text.alias("key"), at.alias("ts"), F.unix_micros(at).alias("us"), F.col(order).cast("long").alias("id"), F.col(value).cast("string").alias("value"))
    judged = standard.where("us is not null and id is not null").withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(
        OrderedRules(window, repeats, run, least), "key string, us long, id long, value string, banned boolean, ended boolean", "Append", "EventTime"
    )
    return judged.select(F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)).alias(key), F.timestamp_micros("us").alias(ts), F.col("id").alias(order), F.col("value").alias(value), "banned", "ended")


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Start a stream that takes what is there, appends it to a Parquet table, and ends."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
