"""Samples and batches: an utterance's characters, words, codes, variants, codec frames and teacher vectors in one row, and padded by batch.

Everything an utterance holds joins by its uid, so rows are independent of any order; words meet the lexicon and the labels as
rows and come back as arrays of one utterance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars, vocab
from ..session import small_side
from .batching import words_to_chars
from .features import fit_length

#: Words of a lexicon, and labels, that are broadcast.
WORDS = 200_000


def assemble(
    rows: DataFrame, ids: DataFrame, lexicon: DataFrame | None = None, labels: DataFrame | None = None, variants: DataFrame | None = None, codes: DataFrame | None = None,
    teacher: DataFrame | None = None, teacher_dim: int = 768, identity: Callable[[Column], Column] = chars.word_identity,
) -> DataFrame:
    """A row for each utterance of rows (uid, text): char_ids, word_index, n_codes, code_target, n_words, variants, and codes or teacher if given.

    ids: one row with a map from character to id. lexicon: word (by identity), n_codes; words that it lacks have one code. labels: uid,
    pos, code; the target of a word with several codes is its label, else -1. variants: uid, variants, used where they fit the text.
    codes: uid, codes; utterances without them are left out. teacher: uid, vectors, cut or filled up with zeros to the number of
    words; null where there are none. A null text is an empty one.
    """
    texts = rows.select("uid", F.coalesce("text", F.lit("")).alias("text"))
    if codes is not None:
        texts = texts.join(codes.select("uid", "codes"), "uid")
    texts = texts.withColumn("spans", chars.word_spans(F.col("text")))
    base = texts.crossJoin(F.broadcast(ids)).withColumn("e", vocab.encode_with_word_index(F.col("text"), F.col("spans"), F.col("ids"))).drop("ids")  # one row
    base = base.withColumn("n_words", F.size("spans"))
    per_word = None
    if lexicon is not None:
        each = texts.select("uid", F.posexplode("spans").alias("pos", "s")).select("uid", "pos", identity(F.col("s.word")).alias("word"))
        known = each.join(small_side(lexicon.select("word", "n_codes").where("n_codes > 1"), WORDS), "word")
        if labels is not None:
            known = known.join(labels.select("uid", "pos", "code"), ["uid", "pos"], "left")
        else:
            known = known.withColumn("code", F.lit(-1))
        entry = F.struct(F.col("n_codes").cast("int").alias("n"), F.coalesce("code", F.lit(-1)).cast("int").alias("code"))
        per_word = known.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("pos", entry.alias("v")))).alias("coded"))  # the words of one text
        base = base.join(per_word, "uid", "left")
    at = lambda field, none: F.transform(F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: F.coalesce(F.try_element_at("coded", i)[field], F.lit(none)))
    filled = lambda none: F.array_repeat(F.lit(none), F.col("n_words"))
    some = F.col("n_words") > 0
    n_codes = F.when(some & F.col("coded").isNotNull(), at("n", 1)).otherwise(filled(1)) if per_word is not None else filled(1)
    target = F.when(some & F.col("coded").isNotNull(), at("code", -1)).otherwise(filled(-1)) if per_word is not None else filled(-1)
    own = F.lit(None).cast("array<int>")
    if variants is not None:
        base = base.join(variants.select("uid", F.col("variants").alias("own")), "uid", "left")
        own = F.col("own")
    columns = [
        "uid", F.col("e.ids").alias("char_ids"), F.col("e.word_index").alias("word_index"), n_codes.alias("n_codes"), target.alias("code_target"), "n_words",
        vocab.row_variants(F.col("text"), own).alias("variants"), *(["codes"] if codes is not None else []),
    ]
    if teacher is not None:
        base = base.join(teacher.select("uid", "vectors"), "uid", "left")
        columns.append(F.when(F.col("vectors").isNotNull(), fit_length(F.col("vectors"), F.col("n_words"), teacher_dim)).alias("teacher"))
    return base.select(*columns)


def _padded(values: Column, to: Column, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, (to - F.size(values)).cast("int")))


def _mask(values: Column, to: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(True), F.size(values)), F.array_repeat(F.lit(False), (to - F.size(values)).cast("int")))


def collate(samples: DataFrame, plan: DataFrame, pad_id: int = 0, max_codes: int = 4, n_quantizers: int = 8, teacher_dim: int = 768) -> DataFrame:
    """The samples of a plan (uid, bucket, batch), each padded to the longest of its batch, with masks.

    char_codes has for each character the target of its word, and max_codes, the slot of no code, outside of words, for words with one
    code and without a target. With codes there are codes, frame_mask and n_frames; with teacher, zeros stand where a sample has none.
    """
    joined = samples.join(plan.select("uid", "bucket", "batch"), "uid")
    has_codes, has_teacher = "codes" in samples.columns, "teacher" in samples.columns
    tops = [F.max(F.size("char_ids")).alias("L"), F.max("n_words").alias("W"), *([F.max(F.size("codes")).alias("T")] if has_codes else [])]
    rows = joined.join(joined.groupBy("bucket", "batch").agg(*tops), ["bucket", "batch"])
    chosen = F.zip_with("n_codes", "code_target", lambda n, c: F.when((n > 1) & (c >= 0), c).otherwise(F.lit(max_codes)))
    length, words = F.col("L"), F.col("W")
    out = [
        "uid", "bucket", "batch", _padded(F.col("char_ids"), length, F.lit(pad_id)).alias("char_ids"), _padded(F.col("word_index"), length, F.lit(-1)).alias("word_index"),
        F.transform(_mask(F.col("char_ids"), length), lambda x: ~x).alias("char_padding"), _padded(F.col("n_codes"), words, F.lit(0)).alias("n_codes"),
        _padded(F.col("code_target"), words, F.lit(-1)).alias("code_target"), _mask(F.col("n_codes"), words).alias("word_mask"),
        _padded(words_to_chars(F.col("word_index"), chosen, F.lit(max_codes)), length, F.lit(max_codes)).alias("char_codes"), _padded(F.col("variants"), length, F.lit(0)).alias("variants"),
    ]
    if has_codes:
        frames = F.col("T")
        out += [_padded(F.col("codes").cast("array<array<int>>"), frames, F.array_repeat(F.lit(0), n_quantizers)).alias("codes"), _mask(F.col("codes"), frames).alias("frame_mask"), F.size("codes").alias("n_frames")]
    if has_teacher:
        out.append(fit_length(F.col("teacher"), words, teacher_dim).alias("teacher"))
    return rows.select(*out)
