"""Native expressions over all matches of a regular expression: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def between(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches: one element more than matches() has. The pattern must not match nothing."""
    return F.split(text, pattern, -1)


#: Elements of an array that one fold goes through; a fold copies what it has gathered at every step.
BLOCK = 256


def bind(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it, in a lambda too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op, kind: str = "int") -> Column:
    """For each value the op (associative; 0 is its neutral element) of all values before it.

    Folds go over blocks and then over the blocks' totals, so the work grows little faster than the array.
    """

    def scan(part):
        empty = F.struct(F.lit(0).cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).cast(kind).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, empty, step)

    def blocks(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: scan(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        return bind(parts, lambda p: F.flatten(F.zip_with(p, scan(F.transform(p, lambda x: x["at"]))["out"], lambda x, base: F.transform(x["out"], lambda o: op(base, o)))))

    return bind(values, lambda v: F.when(F.size(v) > 0, blocks(v)).otherwise(F.array().cast(f"array<{kind}>")))


def starts(found: Column, gaps: Column) -> Column:
    """Code-point offset of each match."""
    first = F.slice(gaps, 1, F.size(found))
    before = running(F.zip_with(first, found, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
    return F.zip_with(before, first, lambda at, g: at + F.length(g))
