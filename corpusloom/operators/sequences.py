"""Rules over ordered values: repetition guard, end of run, nucleus, checkpoints, early stop, monotonic spans, alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repetition_guard(rows: DataFrame, key: str, order: list[str], value: str, window: int = 12, repeats: int = 3) -> DataFrame:
    """rows with banned: the value stands repeats times or more among the window values before, once there are that many."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-window, -1)
    past = F.collect_list(value).over(w)
    return rows.withColumn("__past", past).withColumn("banned", (F.size("__past") == window) & (F.size(F.filter("__past", lambda v: v == F.col(value))) >= repeats)).drop("__past")


def end_of_run(rows: DataFrame, key: str, order: list[str], value: str, run: int = 8, least: int = 0) -> DataFrame:
    """rows with ended: the last run values are equal now or were so before, from position least on."""
    w = Window.partitionBy(key).orderBy(*order)
    last = w.rowsBetween(-(run - 1), 0)
    same = (F.count(value).over(last) == run) & (F.min(value).over(last) == F.max(value).over(last)) & (F.row_number().over(w) >= least)
    return rows.withColumn("__same", same.cast("int")).withColumn("ended", F.max("__same").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("__same")


def nucleus(rows: DataFrame, key: str, item: str, weight: str, top_k: int = 50, top_p: float = 0.95) -> DataFrame:
    """rows of (key, item) that stay, with their share: the top_k by weight (ties with the last stay), then the fewest that pass top_p."""
    whole = Window.partitionBy(key)
    top = rows.withColumn("r", F.rank().over(whole.orderBy(F.desc(weight)))).where(F.col("r") <= top_k)
    top = top.withColumn("p", F.col(weight) / F.sum(weight).over(whole))
    before = F.sum("p").over(whole.orderBy(F.desc(weight), item).rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")
    kept = top.withColumn("before", before).where(F.col("before") <= top_p)
    return kept.withColumn("share", F.col("p") / F.sum("p").over(whole)).select(key, item, "share")


def last_checkpoints(rows: DataFrame, key: str, step: str, metric: str, keep: int = 3) -> DataFrame:
    """The last keep steps of each key and the best one by the least metric (the earliest of equals)."""
    w = Window.partitionBy(key)
    got = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc(step)))).withColumn("best", F.row_number().over(w.orderBy(metric, step)) == 1)
    return got.where((F.col("r") <= keep) | F.col("best")).select(key, step, metric, (F.col("r") <= keep).alias("recent"), "best")


def early_stop(metrics: Column, patience: int = 8, min_delta: float = 0.002) -> Column:
    """Index of the value at which a falling metric stops improving, or -1; a value improves if it beats the recorded best by min_delta."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(-1).alias("stop"), F.lit(0).alias("i"))

    def step(acc, v):
        better = v < acc["best"] - min_delta
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        return F.struct(F.when(better, v.cast("double")).otherwise(acc["best"]).alias("best"), bad.alias("bad"), F.when((acc["stop"] < 0) & (bad >= patience), acc["i"]).otherwise(acc["stop"]).alias("stop"), (acc["i"] + 1).alias("i"))

    return F.aggregate(metrics, start, step, lambda acc: acc["stop"])


def _monotonic(spans: pa.Array) -> pa.Array:
    flat = spans.flatten()
    starts, ends = (np.asarray(flat.field(k), np.float64) for k in (0, 1))
    offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(spans), 0)))])
    keep = np.zeros(len(starts), bool)
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        last = float("-inf")
        for i, (start, end) in enumerate(zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True), a):
            if start >= last:
                keep[i], last = True, end
    kept = pa.StructArray.from_arrays([pa.array(starts[keep]), pa.array(ends[keep])], names=["start", "end"])
    at = np.concatenate([[0], keep.cumsum()])[offsets]
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), kept, mask=spans.is_null())


def monotonic_spans(spans: Column) -> Column:
    """Spans (start, end) in order, without those that begin before the end of the last one kept; null arrays stay null."""
    plain = F.transform(spans, lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end")))
    return F.arrow_udf(_monotonic, "array<struct<start:double,end:double>>")(plain)


def frames_to_seconds(spans: Column, frames: Column, seconds: Column) -> Column:
    """Spans (start, end, score) in frames as spans in seconds, by the frame rate of the whole recording; null without frames or length."""
    rate = F.when((frames > 0) & (seconds > 0), frames / seconds)
    return F.transform(spans, lambda s: F.struct((s["start"] / rate).alias("start"), (s["end"] / rate).alias("end"), s["score"].alias("score")))


def word_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of words from spans of their characters: first start, last end, mean of the characters' scores; characters before 0 don't count."""
    return rows.where("start >= 0").groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score"), F.count("*").alias("n_chars"))


def span_filter(rows: DataFrame, min_word: float = 0.04, max_word: float = 2.5, min_score: float = -6.5) -> DataFrame:
    seconds = F.col("end") - F.col("start")
    return rows.withColumn("kept", (seconds >= min_word) & (seconds <= max_word) & (F.col("score") >= min_score))


def drop_rate(rows: DataFrame) -> DataFrame:
    ok, bad = F.count_if("kept"), F.count_if(~F.col("kept"))
    return rows.agg(ok.alias("n_kept"), bad.alias("n_dropped"), F.round(100 * bad / F.greatest(ok + bad, F.lit(1)), 6).alias("percent"))


def expand_targets(targets: Column, blank: int) -> Column:
    """Blanks before, between and after the targets."""
    return F.concat(F.array(F.lit(blank)), F.flatten(F.transform(targets, lambda t: F.array(t, F.lit(blank)))))


def viterbi(scores: np.ndarray, targets: list[int], blank: int = 0) -> list[tuple[int, int, float]]:
    """Spans (first frame, end, mean score) of each target on the best path through scores [frames, symbols].

    Between frames a path stays, moves on by one state, or skips a blank between two different targets; of equal moves the
    first in this order wins, and of equal ends the later state. Raises if there are fewer frames than the path needs.
    """
    states = [blank]
    for t in targets:
        states += [t, blank]
    n, frames = len(states), len(scores)
    if not targets or frames < n - n // 2:
        raise ValueError(f"{frames} frames are too few for {len(targets)} targets")
    label = np.array(states)
    skips = np.zeros(n, bool)
    skips[2:] = (label[2:] != blank) & (label[2:] != label[:-2])
    emit = scores[:, label].astype(np.float64)
    alpha = np.full(n, -np.inf)
    alpha[:2] = emit[0, :2]
    back = np.zeros((frames, n), np.int8)
    for t in range(1, frames):
        moves = np.full((3, n), -np.inf)
        moves[0], moves[1, 1:] = alpha, alpha[:-1]
        moves[2, 2:] = np.where(skips[2:], alpha[:-2], -np.inf)
        back[t] = moves.argmax(0)
        alpha = np.take_along_axis(moves, back[t][None].astype(np.int64), 0)[0] + emit[t]
    path = np.zeros(frames, np.int64)
    path[-1] = n - 1 if alpha[n - 1] >= alpha[n - 2] else n - 2
    for t in range(frames - 1, 0, -1):
        path[t - 1] = path[t] - back[t, path[t]]
    out = []
    for k, target in enumerate(targets):
        at = np.flatnonzero(path == 2 * k + 1)
        out.append((int(at[0]), int(at[-1]) + 1, float(scores[at[0] : at[-1] + 1, target].mean())) if len(at) else (-1, -1, float("-inf")))
    return out


def align_tokens(plain: Column, marked: Column, key) -> Column:
    """For each plain token the marked token with the same key, or null.

    Lists of one length pair by position. Others are walked: each plain token takes the first match among the next three marked
    ones, and the walk goes on behind it.
    """
    walked = F.arrow_udf(_walk, "array<int>")(F.transform(plain, key), F.transform(marked, key))
    return F.transform(walked, lambda i: F.get(marked, i))


def _walk(plain: pa.Array, marked: pa.Array) -> pa.Array:
    """For each plain key the place of its marked one, or null."""
    pairs = zip(plain.to_pylist(), marked.to_pylist(), strict=True)
    return pa.array([None if p is None or m is None else walk(p, m) for p, m in pairs], pa.list_(pa.int32()))


def walk(plain: list, marked: list) -> list[int | None]:
    """For each plain key the place of its marked one, or None; see align_tokens()."""
    if len(plain) == len(marked):
        return [i if p == m and p is not None else None for i, (p, m) in enumerate(zip(plain, marked, strict=True))]
    out: list[int | None] = []
    at = 0
    for p in plain:
        hit = next((i for i in range(at, min(at + 3, len(marked))) if p is not None and marked[i] == p), None)
        out.append(hit)
        at = at if hit is None else hit + 1
    return out
