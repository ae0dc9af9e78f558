"""Character vocabulary: counting, encoding and decoding."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Ids 0 to 4.
SPECIALS = ["<pad>", "<bos>", "<eos>", "<unk>", " "]
BEGIN, FINISH, UNKNOWN = 1, 2, 3


def char_vocab(texts: DataFrame, min_freq: int = 2) -> DataFrame:
    """id, ch, n: the specials, then characters that occur min_freq times or more, by code point."""
    chars = texts.select(F.explode(F.split("text", "")).alias("ch")).where("ch <> '' and ch <> ' '").groupBy("ch").agg(F.count("*").alias("n")).where(F.col("n") >= min_freq)
    own = chars.select((F.lit(len(SPECIALS) - 1) + F.row_number().over(Window.orderBy("ch"))).alias("id"), "ch", "n")  # a row for each character
    fixed = texts.sparkSession.range(len(SPECIALS), numPartitions=1).select(F.col("id").cast("int"), F.get(F.array(*[F.lit(s) for s in SPECIALS]), F.col("id").cast("int")).alias("ch"), F.lit(None).cast("long").alias("n"))
    return fixed.unionByName(own)


def as_map(vocab: DataFrame) -> DataFrame:
    """One row with a map from character to id."""
    return vocab.agg(F.map_from_entries(F.collect_list(F.struct("ch", F.col("id").cast("int")))).alias("ids"))


def encode(text: Column, ids: Column) -> Column:
    each = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(each, lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(UNKNOWN)))


def decode(codes: Column, chars: Column) -> Column:
    """chars: map from id to character. Padding and marks of beginning and end go, unknowns stay as <unk>."""
    return F.array_join(F.transform(F.filter(codes, lambda i: i >= UNKNOWN), lambda i: F.try_element_at(chars, i)), "")


def word_index(text: Column, spans: Column) -> Column:
    """For each character the number of the word it stands in, else -1."""
    n = F.length(text)
    gaps = F.transform(spans, lambda s, i: F.concat(F.array_repeat(F.lit(-1), (s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))).cast("int")), F.array_repeat(i, (s["end"] - s["start"]).cast("int"))))
    last = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.flatten(gaps), F.array_repeat(F.lit(-1), (n - last).cast("int")))


def encode_with_word_index(text: Column, spans: Column, ids: Column, add_marks: bool = True) -> Column:
    """struct of ids and word_index of a text's characters, with the marks of beginning and end (word -1) around them.

    Raises for a span that is empty or doesn't lie in the text. spans must not overlap and stand in order.
    """
    n = F.length(text)
    bad = F.filter(spans, lambda s: (s["start"] < 0) | (s["end"] > n) | (s["start"] >= s["end"]))
    first = F.get(bad, F.lit(0))
    message = F.concat(F.lit("invalid word span ("), first["start"].cast("string"), F.lit(", "), first["end"].cast("string"), F.lit(") for text of length "), n.cast("string"))
    index = F.when(F.size(bad) > 0, F.raise_error(message).cast("array<int>")).otherwise(word_index(text, spans))
    own = encode(text, ids)
    if add_marks:
        own = F.concat(F.array(F.lit(BEGIN)), own, F.array(F.lit(FINISH)))
        index = F.concat(F.array(F.lit(-1)), index, F.array(F.lit(-1)))
    return F.struct(own.alias("ids"), index.alias("word_index"))


def row_variants(text: Column, variants: Column) -> Column:
    """Variants of a text's characters with a 0 for each mark around them; all 0 if there are not as many as characters."""
    n = F.length(text)
    fits = F.coalesce(F.size(variants) == n, F.lit(False))
    return F.concat(F.array(F.lit(0)), F.when(fits, variants.cast("array<int>")).otherwise(F.array_repeat(F.lit(0), n)), F.array(F.lit(0)))


def char_codes(index: Column, codes: Column, empty: Column) -> Column:
    """For each character the code of its word in the map codes (word number to code), or empty."""
    own = lambda cs: F.transform(index, lambda w: F.coalesce(F.try_element_at(cs, w), empty))
    return F.get(F.transform(F.array(codes), own), F.lit(0))


def save_vocab(vocab: DataFrame, path: str) -> None:
    """A vocabulary as one JSON object; it has a row for each character, so the driver writes it."""
    itos = [r.ch for r in vocab.select("id", "ch").orderBy("id").collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"itos": itos}, f, ensure_ascii=False, indent=2)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """id, ch of a saved vocabulary; raises if one of SPECIALS is missing."""
    with open(path, encoding="utf-8") as f:
        itos = json.load(f)["itos"]
    for special in SPECIALS:
        if special not in itos:
            raise ValueError(f"{path} has no {special!r}")
    return spark.createDataFrame(list(enumerate(itos)), "id int, ch string")
