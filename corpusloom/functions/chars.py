"""Character-level functions: mark classes, folding, cleaning, tokens with offsets."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Three classes of Arabic marks that different steps remove, and characters without content.
MARKS_NORMALIZER = "".join(map(chr, [*range(0x064B, 0x0653), *range(0x0654, 0x0659), 0x0670, *range(0x06D6, 0x06EE)]))
MARKS_TOKENIZER = "".join(map(chr, [*range(0x064B, 0x0660), 0x0670, *range(0x06D6, 0x06EE), 0x0640]))
MARKS_LABELS = "".join(map(chr, [*range(0x064B, 0x0653), 0x0670]))
TATWEEL = "ـ"
INVISIBLE = "".join(map(chr, [0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0xFEFF]))
SOFT_HYPHEN = "­"
ARABIC_INDIC = "".join(map(chr, range(0x0660, 0x066A)))
EXTENDED_INDIC = "".join(map(chr, range(0x06F0, 0x06FA)))
LETTERS = "ء-يٱپچژڤگ"
JUNK = "^><…`"
TRIPLE_DOT, VARIANT = "؞", "~"
FOLD_FROM, FOLD_TO = "أإآٱىة", "اااايه"
PUNCT_TO_SPACE = "«»\"'`´“”‘’()[]{}<>|\\/_*#^~+=@&"
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

WORD = r"[\p{L}\p{N}]+"


def drop(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def western_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_INDIC + EXTENDED_INDIC, "01234567890123456789")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f\x85   -     　]+", " "))


def normalize_composed(text: Column, strip_marks: bool = True, lower: bool = True, fold_alef: bool = False, digits: bool = True) -> Column:
    """normalize_text() for text that is in NFC already."""
    out = F.regexp_replace(drop(text, INVISIBLE), r"[\p{Cc}&&[^\t\n]]", "")
    out = drop(out, MARKS_TOKENIZER) if strip_marks else out
    out = western_digits(out) if digits else out
    out = F.translate(out, FOLD_FROM[:3], FOLD_TO[:3]) if fold_alef else out
    return collapse_spaces(ascii_lower(out) if lower else out)


def with_composed(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a column in NFC. Spark has no function for it, so batches go through Arrow once."""

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(column)
            values = [None if t is None else unicodedata.normalize("NFC", t) for t in b.column(i).to_pylist()]
            yield b.set_column(i, b.schema.field(i), pa.array(values, b.schema.field(i).type))

    return df.mapInArrow(run, df.schema)


def normalize_characters(text: Column, strip_marks: bool = True) -> Column:
    """Character cleaning before verbalisation, for text in NFC."""
    out = drop(text, INVISIBLE + SOFT_HYPHEN)
    return western_digits(drop(out, MARKS_NORMALIZER + TATWEEL) if strip_marks else out)


def strip_label_marks(word: Column) -> Column:
    return drop(word, MARKS_LABELS + TATWEEL + JUNK + TRIPLE_DOT + VARIANT)


def fold_orthography(word: Column) -> Column:
    return F.translate(word, FOLD_FROM, FOLD_TO)


def word_identity(word: Column) -> Column:
    return fold_orthography(strip_label_marks(word))


def fold_latin(word: Column) -> Column:
    """Latin counterpart of word_identity: lower case without accents."""
    low = F.lower(word)  # named in each branch once, as lambdas evaluate every mention
    return F.when(F.octet_length(word) == F.length(word), low).otherwise(F.translate(low, ACCENTED, PLAIN))  # ASCII has no accents


def strip_junk(text: Column) -> Column:
    """White space, Arabic letters and label marks only."""
    return F.regexp_replace(text, rf"[^\s{LETTERS}{MARKS_LABELS}]", "")


def is_arabic_word(word: Column) -> Column:
    return word.rlike("[؀-ۿ]")


def is_arabic_letter(ch: Column) -> Column:
    return ch.rlike(f"^[{LETTERS}]$")


def words(text: Column) -> Column:
    """Maximal runs of letters and numbers."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def split_spaces(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


@cache
def _in_words() -> np.ndarray:
    """Whether a code point is a letter or a number."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


def _spans(texts: pa.Array) -> pa.Array:
    """Spans of the words of each text, by one pass over all code points of some texts at a time."""
    held, parts, at = [t or "" for t in texts.to_pylist()], [], 0
    while at < len(held) or not parts:
        stop, size = at, 0
        while stop < len(held) and (stop == at or size + len(held[stop]) < 1 << 22):
            size += len(held[stop])
            stop += 1
        parts.append(_some_spans(held[at:stop], texts.slice(at, stop - at)))
        at = stop
    return pa.concat_arrays(parts)


def _some_spans(held: list[str], texts: pa.Array) -> pa.Array:
    joined = "\n".join(held)
    inside = _in_words()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in held])]).astype(np.int64)
    at = np.searchsorted(begin, starts)
    base = np.repeat(starts[:-1], np.diff(at))
    words = pa.array([joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.string())
    spans = pa.StructArray.from_arrays([words, pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], names=["word", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans, mask=texts.is_null())


def word_spans(text: Column) -> Column:
    """array of (word, start, end) in code points, linear in the text; a null text gives null.

    Offsets need a running sum, which native array functions can only do by copying the array for each word, so this is an Arrow
    function. Give it a column of its own before it is used in a lambda.
    """
    return F.arrow_udf(_spans, "array<struct<word:string,start:int,end:int>>")(text)


def _numbers(texts: pa.Array) -> pa.Array:
    held = [t or "" for t in texts.to_pylist()]
    offsets = np.r_[0, np.cumsum([len(t) for t in held])].astype(np.int32)
    numbers = np.full(offsets[-1], -1, np.int32)
    for t, a, z in zip(held, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        inside = _in_words()[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
        np.copyto(numbers[a:z], np.cumsum(np.diff(inside.astype(np.int8), prepend=0) == 1, dtype=np.int32) - 1, where=inside)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers), mask=texts.is_null())


def _in_slices(df: DataFrame, column: str, name: str, own, kind: str) -> DataFrame:
    """df with own() of a column of texts in its place, taken of at most 1 MB of text, or one longer text, at a time."""

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(column)
            at, size = 0, 0
            for k, n in enumerate(pc.binary_length(b.column(i)).fill_null(0).to_pylist()):
                if k > at and size + n > 1 << 20:
                    yield _replaced(b.slice(at, k - at), i, name, own)
                    at, size = k, 0
                size += n
            if len(b):
                yield _replaced(b.slice(at), i, name, own)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" if f.name != column else f"{name} {kind}" for f in df.schema]
    return df.mapInArrow(run, ", ".join(fields))


def _replaced(b: pa.RecordBatch, i: int, name: str, own) -> pa.RecordBatch:
    made = own(b.column(i))
    return b.set_column(i, pa.field(name, made.type), made)


def with_word_spans(df: DataFrame, column: str = "text") -> DataFrame:
    """df with spans, the word_spans() of a column, in its place; a worker holds those of few texts at a time."""
    return _in_slices(df, column, "spans", _spans, "array<struct<word:string,start:int,end:int>>")


def with_word_numbers(df: DataFrame, column: str = "text") -> DataFrame:
    """df with word_index in place of a column: for each character the number of the word it stands in, else -1, as vocab.word_index() of word_spans()."""
    return _in_slices(df, column, "word_index", _numbers, "array<int>")


def collapse_elongation(text: Column) -> Column:
    """Four or more of a character in a row become two (digits too)."""
    return F.regexp_replace(text, r"(.)\1{3,}", "$1$1")


def strip_thousands(text: Column) -> Column:
    """1,234,567 becomes 1234567."""
    return F.regexp_replace(text, r"(?<![\p{L}\p{N}_])(?=\d{1,3}(?:[,٬]\d{3})+(?![\p{L}\p{N}_]))|(?<=\d)[,٬](?=\d{3}(?:[,٬]\d{3})*(?![\p{L}\p{N}_]))", "")


SPOKEN_LETTERS = re.compile(f"[{LETTERS}]")
