"""Names under which SQL can call what isn't a built-in function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.sequences import walk
from . import latin, numbers
from .verbalize import verbalize

_WORD = re.compile(r"[^\W_]+")


class TokenizeWithOffsets:
    """Rows (idx, word, start, end) of a text's runs of letters and digits; a null text has none."""

    def eval(self, text: str):
        for i, m in enumerate(_WORD.finditer(text or "")):
            yield i, m[0], m.start(), m.end()


class AlignTokens:
    """Rows (uid, pos, plain, marked) of a table argument partitioned by uid: for each plain token the marked one aligned with it, or null.

    The argument has the columns uid, side ('plain' or 'marked'), pos, token and key, what tokens are compared by. The rule is that of
    align_tokens(): lists of one length pair by position where keys are equal, others are walked. Rows may come in any order.
    """

    def __init__(self):
        self.sides: dict[str, list[tuple[int, str, str | None]]] = {"plain": [], "marked": []}
        self.uid = None

    def eval(self, row):
        self.uid = row["uid"]
        if row["side"] in self.sides and row["pos"] is not None:
            self.sides[row["side"]].append((row["pos"], row["token"], row["key"]))

    def terminate(self):
        plain, marked = (sorted(self.sides[s], key=lambda r: r[0]) for s in ("plain", "marked"))
        own = walk([k for *_, k in plain], [k for *_, k in marked])
        for (pos, token, _), i in zip(plain, own, strict=True):
            yield None if self.uid is None else str(self.uid), pos, token, None if i is None else marked[i][1]


def _context_agreement(left: pd.Series, right: pd.Series, pattern: pd.Series, n: pd.Series) -> float:
    counts = pd.DataFrame({"l": left, "r": right, "p": pattern, "n": n}).dropna(subset=["p", "n"])
    per = counts.groupby(["l", "r", "p"], dropna=False)["n"].sum().groupby(level=["l", "r"], dropna=False).agg(["sum", "max"])
    per = per[per["sum"] > 1]
    return float(per["max"].sum() / per["sum"].sum()) if len(per) else 1.0


def register(spark: SparkSession) -> list[str]:
    """Registers verbalize(text), number_words(n), phone_words(digits), latin_in_arabic(name), the table functions tokenize_with_offsets(text)
    and align_tokens(TABLE(...) PARTITION BY uid), and the aggregate context_agreement(left, right, pattern, n).

    The aggregate is the share of repeated contexts' occurrences that take their context's most frequent pattern, 1 where no context
    repeats. A group meets in one task, so give it counts of contexts rather than occurrences: their number is that of different contexts.
    """
    one = lambda f: lambda xs: xs.map(lambda x: None if pd.isna(x) else f(x))
    scalar = {
        "verbalize": one(verbalize),
        "number_words": one(lambda n: numbers.say(int(n))),
        "phone_words": one(numbers.say_phone),
        "latin_in_arabic": one(latin.transliterate),
    }
    for name, f in scalar.items():
        spark.udf.register(name, F.pandas_udf(lambda xs, f=f: f(xs).astype(object), "string", F.PandasUDFType.SCALAR))
    spark.udtf.register("tokenize_with_offsets", F.udtf(TokenizeWithOffsets, returnType="idx int, word string, start int, `end` int"))
    spark.udtf.register("align_tokens", F.udtf(AlignTokens, returnType="uid string, pos int, plain string, marked string"))
    spark.udf.register("context_agreement", F.pandas_udf(_context_agreement, "double", F.PandasUDFType.GROUPED_AGG))
    return [*scalar, "tokenize_with_offsets", "align_tokens", "context_agreement"]
