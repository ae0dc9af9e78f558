"""A corpus folder as tables: the normalised manifest with its reasons to skip rows, and words with their marked forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars, marks
from ..functions.verbalize import verbalized
from ..plans.config import Text
from ..plans.report import table_lines
from . import readings
from .manifest import Limits, skip_reason
from .sequences import align_tokens

#: The reasons of skip_reason(), in its order.
REASONS = ["no_path", "missing_audio", "empty_text", "too_long_text", "duration", "word_count"]


def normalised(rows: DataFrame, text: Text = Text(), verbal: bool = True) -> DataFrame:
    """rows (text) with raw, the text as it was, and text in its spoken and normalised form; a null text becomes an empty one."""
    rows = rows.withColumn("raw", F.coalesce("text", F.lit(""))).withColumn("text", F.col("raw"))
    if verbal:
        rows = verbalized(rows, "text", punctuation=False, strip_marks=text.strip_marks)
    rows = chars.with_composed(rows)
    return rows.withColumn("text", chars.normalize_composed(F.col("text"), text.strip_marks, text.lower, text.fold_alef, text.digits))


def with_reasons(rows: DataFrame, text: Text = Text()) -> DataFrame:
    """Normalised rows (audio_path, text, duration, and missing if recordings were looked for) with skip_reason, null for rows to keep."""
    limits = Limits(text.min_duration, text.max_duration, text.max_chars, text.max_words)
    missing = F.col("missing") if "missing" in rows.columns else F.lit(False)
    n_words = F.size(chars.words(F.col("text")))
    return rows.withColumn("skip_reason", skip_reason(F.col("audio_path"), missing, F.col("text"), F.col("duration"), n_words, limits))


def metrics() -> dict[str, Column]:
    """What a manifest says of itself while it is written: rows seen and kept, hours kept, the range of durations, and rows by reason."""
    kept = F.col("skip_reason").isNull()
    by_reason = {r: F.count_if(F.col("skip_reason") == r) for r in REASONS}
    return {"n": F.count(F.lit(1)), "n_kept": F.count_if(kept), "hours": F.sum(F.when(kept, F.col("duration"))) / 3600, "shortest": F.min("duration"), "longest": F.max("duration")} | by_reason


def refuse_empty(m: dict) -> str | None:
    """Why a manifest without rows is not written."""
    if m["n_kept"]:
        return None
    reasons = ", ".join(f"{r}: {m[r]}" for r in REASONS if m[r]) or "there were none"
    return f"every utterance was filtered out ({reasons}); durations {m['shortest']} to {m['longest']} s"


def summary(m: dict, alarm: float = 0.9) -> list[str]:
    """Lines of a report on the metrics: skipped rows by reason, and an alarm if less than alarm of all rows was kept."""
    lines = [f"{m['n_kept']} of {m['n']} utterances, {m['hours'] or 0:.2f} hours"]
    skipped = [(r, m[r]) for r in sorted(REASONS) if m[r]]
    if skipped:
        lines += table_lines(["reason", "count"], skipped)
    if m["n"] and m["n_kept"] < alarm * m["n"]:
        reason, n = max(skipped, key=lambda x: x[1])
        lines.append(f"KEPT ONLY {100 * m['n_kept'] / m['n']:.0f}% OF THE CORPUS; largest cause: {reason} ({n})")
        if reason == "duration":
            lines.append(f"durations are {m['shortest']} to {m['longest']} s: widen the limits to keep them")
    return lines


def marked_occurrences(pairs: DataFrame) -> DataFrame:
    """Occurrences of rows (uid, text, diacritized): plain words by identity, with the pattern and form of the marked word aligned with each.

    Words without a marked counterpart, or whose counterpart has no letters, give none.
    """
    plain, marked = chars.split_spaces(F.col("text")), chars.split_spaces(chars.strip_junk(F.col("diacritized")))
    rows = pairs.select("uid", plain.alias("plain"), align_tokens(plain, marked, chars.word_identity).alias("marked"))
    both = F.arrays_zip("plain", "marked")
    return readings.occurrences(rows, both, lambda t: chars.word_identity(t["plain"]), lambda t: F.when(t["marked"].isNotNull(), F.nullif(marks.vowel_pattern(t["marked"]), F.lit(""))), lambda t: t["marked"])


def marked_variants(pairs: DataFrame) -> DataFrame:
    """uid, variants of rows (uid, text, diacritized): a number for each character of the text, its words joined by single spaces."""
    plain = chars.split_spaces(F.col("text"))
    marked = chars.split_spaces(marks.normalize_variant_marks(F.col("diacritized")))
    rows = pairs.select("uid", plain.alias("plain"), align_tokens(plain, marked, chars.word_identity).alias("marked"))

    def one(pair, i):
        zeros = F.array_repeat(F.lit(0), F.length(pair["plain"]))
        own = marks.letter_variants(F.coalesce(pair["marked"], F.lit("")))
        fits = F.when(F.size(own) == F.length(pair["plain"]), F.transform(own, lambda x: F.least(x, F.lit(9)))).otherwise(zeros)
        return F.when(i > 0, F.concat(F.array(F.lit(0)), fits)).otherwise(fits)

    return rows.select("uid", F.flatten(F.transform(F.arrays_zip("plain", "marked"), one)).alias("variants"))
