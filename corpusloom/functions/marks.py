"""Diacritised words: letters with their marks, vowel patterns, variants, and codes from partial marks. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import JUNK, LETTERS, MARKS_LABELS, TRIPLE_DOT, VARIANT, word_identity

# Single marks and letters with rules of their own.
SUKUN, SHADDA = "ْ", "ّ"
LONG_VOWELS = "اويى"
ARTICLE = ("ا", "ل")
NO_OWN_VOWEL = "ةه"
TAA = "ة"
VARIANT_LETTERS = "قجف"


def _once(value: Column, use) -> Column:
    """use(value) with value computed once; a lambda that names an expression from outside computes it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def letter_marks(word: Column) -> Column:
    """array of (letter, marks): marks belong to the letter before them; all else is dropped."""
    clean = F.regexp_replace(word, f"[^{LETTERS}{MARKS_LABELS}]", "")
    pieces = F.regexp_extract_all(clean, F.lit(f"[{LETTERS}][{MARKS_LABELS}]*"), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(F.substring(p, 1, 1).alias("letter"), F.substring(p, F.lit(2), F.length(p)).alias("marks")))


def clean_marks(pairs: Column) -> Column:
    """Pairs without marks that can't encode a pronunciation; the rules look at a letter, its place and its neighbours only.

    First letters carry none; long vowels after the first carry no sukun; neither does the l of an article carry any; a final
    letter without a vowel of its own and the one before it carry none; the last of several letters isn't doubled.
    """
    return _once(pairs, _cleaned)


def _cleaned(pairs: Column) -> Column:
    n = F.size(pairs)
    last = F.get(pairs, n - 1)["letter"]
    article = (n >= 2) & (F.get(pairs, F.lit(0))["letter"] == ARTICLE[0]) & (F.get(pairs, F.lit(1))["letter"] == ARTICLE[1])
    ending = last.isin(*NO_OWN_VOWEL)

    def one(p, i):
        bare = (i == 0) | ((i == 1) & article) | (ending & (i >= n - 2))
        marks = F.when(p["letter"].isin(*LONG_VOWELS), F.replace(p["marks"], F.lit(SUKUN), F.lit(""))).otherwise(p["marks"])
        marks = F.when((i == n - 1) & (n >= 2), F.replace(marks, F.lit(SHADDA), F.lit(""))).otherwise(marks)
        return F.struct(p["letter"].alias("letter"), F.when(bare, "").otherwise(marks).alias("marks"))

    return F.transform(pairs, one)


def _slot(marks: Column) -> Column:
    others = F.array_join(F.array_sort(F.filter(F.split(F.replace(marks, F.lit(SHADDA), F.lit("")), ""), lambda c: c != "")), "")
    slot = F.concat(F.when(marks.contains(SHADDA), "+").otherwise(""), others)
    return F.when(slot == "", "-").otherwise(slot)


def vowel_pattern(word: Column, drop_case_ending: bool = True) -> Column:
    """A slot for each letter, joined by |; without the last letter's vowel, as case endings aren't spoken. Empty without letters."""

    def joined(pairs):
        n = F.size(pairs)
        return F.array_join(F.transform(pairs, lambda p, i: F.when((i == n - 1) & (n > 1) & F.lit(drop_case_ending), F.when(p["marks"].contains(SHADDA), "+").otherwise("-")).otherwise(_slot(p["marks"]))), "|")

    return _once(clean_marks(letter_marks(word)), joined)


def normalize_variant_marks(text: Column) -> Column:
    """Junk goes; a triple dot or tilde becomes a tilde where the last letter before it can vary, and goes elsewhere."""
    clean = F.translate(text, JUNK, "")
    marked = F.replace(clean, F.lit(TRIPLE_DOT), F.lit(VARIANT))
    runs = F.regexp_extract_all(marked, F.lit(f"[{LETTERS}][^{LETTERS}]*|^[^{LETTERS}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(F.substring(r, 1, 1).isin(*VARIANT_LETTERS), r).otherwise(F.replace(r, F.lit(VARIANT), F.lit("")))), "")


def letter_variants(word: Column) -> Column:
    """A number for each letter: 1 for a marked letter that can vary, 2 for a final taa marbuta with sukun, else 0."""
    clean = F.replace(F.regexp_replace(word, f"[^{LETTERS}{MARKS_LABELS}{TRIPLE_DOT}{VARIANT}]", ""), F.lit(TRIPLE_DOT), F.lit(VARIANT))
    pieces = F.regexp_extract_all(clean, F.lit(f"[{LETTERS}][{MARKS_LABELS}{VARIANT}]*"), F.lit(0))
    varies = lambda p: F.substring(p, 1, 1).isin(*VARIANT_LETTERS) & p.contains(VARIANT)
    return _once(pieces, lambda ps: F.transform(ps, lambda p, i: F.when((i == F.size(ps) - 1) & p.startswith(TAA) & p.contains(SUKUN), 2).when(varies(p), 1).otherwise(0)))


def variant_string(plain: Column, diacritized: Column) -> Column:
    """A digit for each character of plain: the aligned words' variants, 0 elsewhere and for words whose letters don't match in number.

    plain has single spaces between words; both have as many words.
    """
    words, marked = F.split(plain, " "), F.split(diacritized, " ")

    def one(w, i):
        v = letter_variants(F.get(marked, i))
        return F.when(F.size(v) == F.length(w), F.array_join(F.transform(v, lambda x: F.least(x, F.lit(9)).cast("string")), "")).otherwise(F.repeat(F.lit("0"), F.length(w)))

    return F.array_join(F.transform(words, one), "0")


# The reasons that partial_codes() gives.
NOT_IN_LEXICON = "word not in the lexicon"
SINGLE = "single reading"
NO_MARKS = "no diacritics supplied"
UNREADABLE = "could not parse the marks given"
OTHER_LENGTH = "marks do not line up with any known reading"
NO_DISTINCTION = "the marks given fall on positions the lexicon does not distinguish (word-initial letter or case ending); mark an interior vowel instead"
ONLY_ONE = (" has only one learned reading (", ", ", " uses); the reading asked for is not in the corpus often enough to have been learned")
CONFLICT = "marks conflict with every known reading"
SEVERAL = "marks match several readings equally"
MATCHED = ("matched ", " mark(s) with no conflict")


def partial_codes(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens (id, token) with the code their marks choose from a nested lexicon (word, patterns, examples, total), and the reason.

    Each reading is scored by the marked letters on which it agrees or conflicts; the one with most agreements and no conflict
    wins, if it is the only one.
    """
    pairs = letter_marks(F.col("token"))
    rows = tokens.select("*", word_identity(F.col("token")).alias("word"), F.transform(pairs, lambda p: p["marks"] != "").alias("given"), F.split(vowel_pattern(F.col("token")), r"\|").alias("slots"))
    rows = rows.join(lexicon, "word", "left")

    def score(pattern, code):
        theirs = F.split(pattern, r"\|")
        marked = F.filter(F.arrays_zip(F.col("given").alias("g"), F.col("slots").alias("u"), theirs.alias("t")), lambda z: z["g"] & ~((z["u"] == "-") & (z["t"] == "-")))
        agree = F.size(F.filter(marked, lambda z: z["u"] == z["t"]))
        return F.struct(agree.alias("agree"), (F.size(marked) - agree).alias("conflict"), code.alias("code"), (F.size(theirs) == F.size("slots")).alias("fits"))

    rows = rows.withColumn("scored", F.filter(F.transform("patterns", score), lambda s: s["fits"]))
    rows = rows.withColumn("clean", F.filter("scored", lambda s: (s["conflict"] == 0) & (s["agree"] > 0)))
    rows = rows.withColumn("best", F.array_max(F.transform("clean", lambda s: s["agree"]))).withColumn("top", F.filter("clean", lambda s: s["agree"] == F.col("best")))
    one, marked = F.size("patterns") == 1, F.exists("given", lambda g: g)
    learned = F.concat(F.col("token"), F.lit(ONLY_ONE[0]), F.get("examples", F.lit(0)), F.lit(ONLY_ONE[1]), F.col("total").cast("string"), F.lit(ONLY_ONE[2]))
    reason = (
        F.when(F.col("patterns").isNull(), NOT_IN_LEXICON)
        .when(~marked & one, SINGLE)
        .when(~marked, NO_MARKS)
        .when(F.size("given") != F.size("slots"), UNREADABLE)
        .when(F.size("scored") == 0, OTHER_LENGTH)
        .when((F.size("clean") == 0) & ~F.exists("scored", lambda s: s["agree"] + s["conflict"] > 0), NO_DISTINCTION)
        .when((F.size("clean") == 0) & one, learned)
        .when(F.size("clean") == 0, CONFLICT)
        .when(F.size("top") > 1, SEVERAL)
        .otherwise(F.concat(F.lit(MATCHED[0]), F.col("best").cast("string"), F.lit(MATCHED[1])))
    )
    rows = rows.withColumn("reason", reason)
    code = F.when(F.col("reason") == SINGLE, 0).when(F.col("reason").startswith(MATCHED[0]) & F.col("reason").endswith(MATCHED[1]), F.get("top", F.lit(0))["code"]).otherwise(-1)
    return rows.select(*tokens.columns, code.cast("int").alias("code"), "reason")

