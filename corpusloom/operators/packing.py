"""Dealing keys of very different cost to tasks: the dearest first, each to the task that has least so far.

Only keys that are dear enough to make a task uneven are placed one by one, and there are at most HEAVY for each task of them,
whatever the number of keys; all others are dealt by hash over the room that is left. rows_by_task() then sends each row to the
task of its key, so a task's work is what was planned and not what hashes happen to bring together.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_side

#: A key is placed on its own if it costs more than 1 / HEAVY of what a task should bear.
HEAVY = 16


def longest_first(costs: list[tuple[object, float]], tasks: int, base: float = 0.0) -> tuple[dict[object, int], list[float]]:
    """Each key's task, and the tasks' loads: keys by falling cost (then by name), each to the least loaded task (the first of equals)."""
    loads = [(base, t) for t in range(tasks)]
    heapq.heapify(loads)
    placed = {}
    for key, cost in sorted(costs, key=lambda x: (-x[1], str(x[0]))):
        load, t = heapq.heappop(loads)
        placed[key] = t
        heapq.heappush(loads, (load + cost, t))
    out = [0.0] * tasks
    for load, t in loads:
        out[t] = load
    return placed, out


def pack(costs: DataFrame, key: str, cost: str, tasks: int) -> DataFrame:
    """key, task of rows (key, cost), a row for each key: loads are near the mean wherever no single key costs more than that."""
    costs = materialize(costs.select(F.col(key).alias("key"), F.col(cost).cast("double").alias("cost")), "costs")
    total = costs.agg(F.sum("cost")).first()[0] or 0.0
    limit = total / tasks / HEAVY
    dear = costs.where(F.col("cost") > limit).collect()  # fewer than HEAVY for each task, as they cost more than the whole otherwise
    placed, loads = longest_first([(r.key, r.cost) for r in dear], tasks)
    mean = total / tasks
    room = [max(mean - load, 0.0) for load in loads]
    if not sum(room):
        room = [1.0] * tasks
    ends, at = [], 0.0
    for r in room:
        at += r
        ends.append(at / sum(room))
    # the rest is dealt by hash over the tasks' room
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / float(1 << 40)
    dealt = F.size(F.filter(F.array(*[F.lit(e) for e in ends[:-1]]), lambda e: e <= share)) if tasks > 1 else F.lit(0)
    rest = costs.where(F.col("cost") <= limit).select("key", dealt.cast("int").alias("task"))
    rest = rest.unionByName(costs.where("cost is null").select("key", F.lit(0).alias("task")))
    out = rest
    if placed:
        out = rest.unionByName(costs.sparkSession.createDataFrame(list(placed.items()), out.schema))
    return out.select(F.col("key").alias(key), "task")


def rows_by_task(rows: DataFrame, key: str, packed: DataFrame, tasks: int) -> DataFrame:
    """rows, each in the partition that its key was packed to, and there in the order of keys; keys that were not packed are left out."""
    dealt = rows.join(small_side(materialize(packed, "packed"), 200_000), key)
    return dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions(key).drop("task")


def apply_by_key(dealt: DataFrame, key: str, one: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """one() of the rows of each key, of rows that rows_by_task() dealt: nothing is shuffled again. A task holds one key's rows, and a batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            cut = (part[key] != part[key].shift()).to_numpy().nonzero()[0].tolist()
            for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
                piece = part.iloc[a:b]
                if held and held[-1][key].iloc[0] != piece[key].iloc[0]:
                    yield one(pd.concat(held, ignore_index=True))
                    held = []
                held.append(piece)
        if held:
            yield one(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(run, schema)
