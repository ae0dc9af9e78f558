"""Romanisation of Arabic text for alignment, with the source of each emitted character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and short vowels to Latin.
LETTERS = {
    "ا": "a", "أ": "a", "إ": "i", "آ": "a", "ء": "'", "ئ": "'", "ؤ": "'", "ى": "a", "ب": "b", "ت": "t", "ث": "s", "ج": "g", "ح": "h", "خ": "kh",
    "د": "d", "ذ": "z", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "'", "غ": "gh", "ف": "f", "ق": "'",
    "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "ة": "a", "پ": "p", "چ": "ch", "ژ": "j", "ڤ": "v", "گ": "g",
}
VOWELS = {"َ": "a", "ُ": "u", "ِ": "i", "ً": "an", "ٌ": "un", "ٍ": "in"}
TABLE = LETTERS | VOWELS
_MAP = [x for pair in TABLE.items() for x in pair]


def _one(c: Column) -> Column:
    plain = F.when(c.rlike(r"^[\s\x1c-\x1f\x85\xa0  -     　]$"), " ").when(c.rlike("^[A-Za-z]$"), F.lower(c)).otherwise("")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in _MAP]), c), plain)


_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SINGLE = {k: v for k, v in TABLE.items() if len(v) == 1}


def romanize(text: Column) -> Column:
    """Latin text; white space one for one, digits and marks without a counterpart are dropped."""
    out = F.regexp_replace(F.regexp_replace(text, _SPACE, " "), f"[^A-Za-z {''.join(TABLE)}]", "")
    out = F.translate(F.lower(out), "".join(_SINGLE), "".join(_SINGLE.values()))
    for letter, latin in TABLE.items():
        if len(latin) > 1:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def romanize_with_map(text: Column) -> Column:
    """array of (char, source): each emitted character with the index of the character it stands for."""
    each = F.transform(F.split(text, ""), lambda c, i: F.transform(F.filter(F.split(_one(c), ""), lambda x: x != ""), lambda x: F.struct(x.alias("char"), i.alias("source"))))
    return F.flatten(each)


def alignment_targets(text: Column, vocabulary: dict[str, int]) -> Column:
    """array of (id, source) for characters in the vocabulary; spaces and unknown characters are left out."""
    ids = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    named = F.transform(romanize_with_map(text), lambda s: F.struct(F.when(s["char"] != " ", F.try_element_at(ids, s["char"])).alias("id"), s["source"].alias("source")))
    return F.filter(named, lambda s: s["id"].isNotNull())


# How vocabularies write a space, the first that one has counts.
SPACES = ["|", "<space>", " "]


def native_targets(text: Column, vocabulary: dict[str, int]) -> Column:
    """array of (id, source) of a text in its own script: a character as it is, else in upper case; unknown ones are left out.

    A character whose id is 0 is looked up in upper case too.
    """
    ids = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    space = next((vocabulary[s] for s in SPACES if s in vocabulary), None)

    def one(c, i):
        own = F.nullif(F.try_element_at(ids, c), F.lit(0))
        found = F.when(c == " ", F.lit(space).cast("int")).otherwise(F.coalesce(own, F.try_element_at(ids, F.upper(c))))
        return F.struct(found.alias("id"), i.alias("source"))

    return F.filter(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), lambda x: x["id"].isNotNull())
