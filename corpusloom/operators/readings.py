"""Mining the readings of words: which patterns a word takes, how often, and whether its context decides.

An occurrence is (uid, pos, word, pattern, form, left, right). Occurrences are made anew from the texts wherever they are used:
that reads and cuts a text again, but moves nothing.

Most occurrences belong to words with several patterns, whose number grows with the corpus, so occurrences are never joined with
words: they are counted by pattern, or by context and pattern, and the counts are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, small_side

#: Words of a table that is broadcast.
WORDS = 200_000
#: Occurrences that one task counts by context.
ROWS_PER_TASK = 1_000_000
#: Occurrences that are counted at once in Arrow, by the tasks that send them and by those that get them.
ROWS_PER_BLOCK, ROWS_PER_COUNT = 1_000_000, 2_000_000
BEGIN, FINISH = "<s>", "</s>"


@dataclass(frozen=True)
class Gates:
    min_word_freq: int = 5
    min_pattern_count: int = 3
    min_pattern_frac: float = 0.08
    max_codes: int = 4
    max_raw_patterns: int = 4
    min_context_agreement: float = 0.75


def occurrences(sentences: DataFrame, tokens: Column, identity, pattern, form=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of rows (uid) with an array of tokens; neighbours come from the array itself, so nothing is shuffled.

    identity, pattern and form are functions of a token's column; form defaults to the token. Null patterns are left out. keep names
    columns of the sentences that stay.
    """
    rows = sentences.select("uid", *keep, tokens.alias("ts"))
    # an inner explode asks for arrays that aren't empty, below it, and so cuts each text twice
    rows = rows.select("uid", *keep, "ts", F.posexplode_outer("ts").alias("pos", "t")).where("pos is not null")
    token, beside = F.col("t"), lambda by: F.get("ts", F.col("pos") + by)
    left = F.when(F.col("pos") > 0, identity(beside(-1))).otherwise(F.lit(BEGIN))
    right = F.when(F.col("pos") < F.size("ts") - 1, identity(beside(1))).otherwise(F.lit(FINISH))
    own = [identity(token).alias("word"), pattern(token).alias("pattern"), (form(token) if form else token).alias("form")]
    return rows.select("uid", *keep, "pos", *own, left.alias("left"), right.alias("right")).where("pattern is not null")


@dataclass(frozen=True)
class Texts:
    """The arguments of occurrences(), for what need not make a row of each: pattern_counts() and dealt_shapes().

    pattern defaults to the token. identity and pattern are used inside lambdas, so they are native expressions.
    """

    sentences: DataFrame
    tokens: Column
    identity: Callable[[Column], Column]
    pattern: Callable[[Column], Column] | None = None
    form: Callable[[Column], Column] | None = None
    keep: tuple[str, ...] = ()

    def _pattern(self, token: Column) -> Column:
        return self.pattern(token) if self.pattern else token

    def occurrences(self) -> DataFrame:
        return occurrences(self.sentences, self.tokens, self.identity, self._pattern, self.form, self.keep)

    def forms(self, *counts: Column) -> DataFrame:
        """word, pattern, form and counts of each token, whose word, pattern and form are made once; a form may have several tokens."""
        rows = self.sentences.select("uid", *self.keep, F.posexplode_outer(self.tokens).alias("pos", "t")).where("pos is not null")
        token = F.col("t")
        counted = rows.groupBy("t").agg(F.count("*").alias("n"), _first(rows).alias("first"), *counts)
        own = [self.identity(token).alias("word"), self._pattern(token).alias("pattern"), (self.form(token) if self.form else token).alias("form")]
        return counted.select(*own, *counted.columns[1:]).where("pattern is not null")

    def hashes(self, *more: Column) -> DataFrame:
        """words, patterns and more columns of each text: 64 bits of its tokens' words, with both ends, and of their patterns.

        Null texts stay: a filter would move below and cut each text again.
        """
        ends = [F.array(F.xxhash64(F.lit(e))) for e in (BEGIN, FINISH)]
        words = F.concat(ends[0], F.transform("ts", lambda t: F.xxhash64(self.identity(t))), ends[1])
        patterns = F.transform("ts", lambda t: F.when(self._pattern(t).isNotNull(), F.xxhash64(self._pattern(t))))
        return self.sentences.select("uid", self.tokens.alias("ts"), *self.keep).select(words.alias("words"), patterns.alias("patterns"), *more)


def _place(occ: DataFrame) -> Column:
    """uid and pos as one number, which a hash aggregate can hold; uids that aren't whole numbers stay a struct."""
    if isinstance(occ.schema["uid"].dataType, T.IntegralType):
        return F.col("uid").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    return F.struct("uid", "pos")


def _first(occ: DataFrame) -> Column:
    """The least _place(); of uids that leave room for it a long is compared, as long decimals are objects."""
    if not isinstance(occ.schema["uid"].dataType, T.IntegralType):
        return F.min(_place(occ))
    uid, whole = F.col("uid").cast("long"), "decimal(32,0)"
    near = uid.between(-(1 << 32), (1 << 32) - 1)
    return F.least(F.min(F.when(near, F.shiftleft(uid, 31) + F.col("pos"))).cast(whole), F.min(F.when(~near, _place(occ))).cast(whole))


def contexts(occ: DataFrame) -> DataFrame:
    """word, left, right, pattern, n: counts of each pattern in each context."""
    return occ.groupBy("word", "left", "right", "pattern").agg(F.count("*").alias("n"))


def dealt_contexts(occ: DataFrame, size: int | None = None, *counts: Column) -> DataFrame:
    """word, left, right, pattern, n and more counts, as contexts() has them, but left and right are hashes, 96 bits of both, and rows lie by context.

    Occurrences are shuffled once, by word and context, so what groups by (word, left, right) shuffles nothing. The number of tasks
    follows size, the number of occurrences, which is counted if it isn't known.
    """
    size = occ.count() if size is None else size
    by = [F.xxhash64("left", "right").alias("left"), F.hash("right", "left").alias("right")]
    more = [c for c in occ.columns if c not in ("uid", "pos", "word", "pattern", "form", "left", "right")]
    # a pattern that is its word, as most are, is moved as null
    rows = occ.select("word", *by, F.nullif("pattern", "word").alias("pattern"), *more).repartition(max(8, -(-size // ROWS_PER_TASK)), "word", "left")
    return rows.withColumn("pattern", F.coalesce("pattern", "word")).groupBy("word", "left", "right", "pattern").agg(F.count("*").alias("n"), *counts)


def context_shapes(counted: DataFrame, *more: str) -> DataFrame:
    """word, shape, contexts of dealt contexts: how many contexts of a word have these patterns, each with its counts, by pattern."""
    rows = counted.groupBy("word", "left", "right").agg(F.array_sort(F.collect_list(F.struct("pattern", "n", *more))).alias("shape"))  # the patterns of one context
    return rows.groupBy("word", "shape").agg(F.count("*").alias("contexts"))


def _counted(batches: Iterator[pa.RecordBatch], keys: list[str], held: bool, rest: bool = True) -> pa.Table:
    """Rows by keys with their number n, and the number of held ones; what is counted is merged, so equal rows don't pile up.

    Batches that have n are counts already. Without rest, rows that came after the last merge may equal others.
    """
    sums = [("n", "sum")] + [("held", "sum")] * held
    names = ["n"] + ["held"] * held

    def merged(parts: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate(sums)
        return got.rename_columns([c.removesuffix("_sum") for c in got.column_names]).select([*keys, *names])

    whole, waiting, n = [], [], 0
    for b in batches:
        t = pa.Table.from_batches([b])
        waiting.append(t if "n" in t.column_names else t.append_column("n", pa.array(np.ones(len(t), np.int64))))
        n += len(t)
        if n >= ROWS_PER_COUNT:
            whole, waiting, n = [*whole, merged(waiting)], [], 0
            if sum(map(len, whole[1:])) > len(whole[0]):  # sizes double, so a row is merged a few times only
                whole = [merged(whole)]
    if not rest:
        return pa.concat_tables(whole + waiting) if whole or waiting else None
    whole += [merged(waiting)] if waiting else []
    return merged(whole) if len(whole) > 1 else whole[0] if whole else None


def _mixed(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """64 bits of word and context."""
    mixed = (word * np.int64(-7046029254386353131) ^ context) * np.int64(-4417276706812531889)
    return mixed ^ ((mixed >> np.int64(32)) & np.int64(0xFFFFFFFF))


def _part_of(number: np.ndarray, parts: int) -> np.ndarray:
    """The part of numbers by their first bits: a part of 2 * n parts lies in one of n."""
    return ((((number >> np.int64(32)) + (1 << 31)) * parts) >> 32).astype(np.int32)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, context, pattern and maybe held of each occurrence of Texts.hashes()."""
    for b in batches:
        b = b.filter(b["patterns"].is_valid())
        lengths, pattern = b["patterns"].value_lengths().to_numpy(), b["patterns"].flatten()
        words = b["words"].flatten().to_numpy()
        at = np.arange(len(pattern)) + 2 * np.repeat(np.arange(len(lengths)), lengths) + 1  # each text has two ends
        held = {"held": np.repeat(b["held"].to_numpy(), lengths)} if "held" in b.schema.names else {}
        rows = pa.RecordBatch.from_pydict({"word": words[at], "context": _mixed(words[at - 1], words[at + 1]), "pattern": pattern, **held})
        yield from _cut(rows.filter(pattern.is_valid()) if pattern.null_count else rows, ROWS_PER_BLOCK)


def _occurrence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, context, pattern and maybe held of occurrences by hashes; contexts are those of _text_rows()."""
    for b in batches:
        context = pa.array(_mixed(b["left"].to_numpy(), b["right"].to_numpy()))
        yield b.drop_columns(["left", "right"]).append_column("context", context)


def _first_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """word, pattern, uid, pos of the first k occurrences of each pattern of each word in a batch of Texts.hashes()."""
    for b in batches:
        b = b.filter(b["patterns"].is_valid())
        lengths, pattern = b["patterns"].value_lengths().to_numpy(), b["patterns"].flatten()
        doc = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(pattern))
        word = b["words"].flatten().to_numpy()[at + 2 * doc + 1]
        pos = at - (np.cumsum(lengths) - lengths)[doc]
        if pattern.null_count:
            chosen = np.flatnonzero(pattern.is_valid())
            doc, word, pos, pattern = doc[chosen], word[chosen], pos[chosen], pattern.drop_null()
        pattern = pattern.to_numpy()
        place = (pc.rank(b["uid"], tiebreaker="dense").to_numpy().astype(np.int64)[doc] << 31) + pos
        order = np.lexsort([place, _mixed(word, pattern)])  # patterns of one number may be cut by each other, into more rows
        new = np.flatnonzero(_changes(word[order], pattern[order]))
        size = np.diff(np.r_[new, len(order)])
        order = order[np.arange(len(order)) - np.repeat(new, size) < k]
        rows = {"word": word[order], "pattern": pattern[order], "uid": b["uid"].take(pa.array(doc[order])), "pos": pos[order].astype(np.int32)}
        yield from pa.Table.from_pydict(rows).to_batches(max_chunksize=10_000)


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (word, context, pattern and maybe held) as one row for each part and million of rows; equal ones are counted.

    All rows of a word and context have one part, by the first bits of their number.
    """

    def block(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(waiting)
        cols = {c: t[c].to_numpy() for c in t.column_names}
        number = (_mixed(cols["word"], cols["context"]) & np.int64(~0xFFFF)) | (cols["pattern"] & np.int64(0xFFFF))  # equal rows stand together
        order = np.argsort(number)
        cols, number = {c: v[order] for c, v in cols.items()}, number[order]
        start = np.flatnonzero(_changes(cols["word"], cols["context"], cols["pattern"]))
        part = _part_of(number[start], parts)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        offsets = pa.array(np.r_[first, len(start)].astype(np.int32))
        sums = {"n": np.diff(np.r_[start, len(number)])} | ({"held": np.add.reduceat(cols["held"], start)} if "held" in cols else {})
        lists = {c: pa.ListArray.from_arrays(offsets, pa.array(v)) for c, v in ({c: cols[c][start] for c in ("word", "context", "pattern")} | sums).items()}
        return pa.RecordBatch.from_pydict({"part": pa.array(part[first]), **lists})

    waiting, n = [], 0
    for b in batches:
        waiting.append(b)
        n += len(b)
        if n >= ROWS_PER_BLOCK:
            yield from _cut(block(waiting), 1000)
            waiting, n = [], 0
    if n:
        yield from _cut(block(waiting), 1000)


def _cut(whole: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    return (whole.slice(k, size) for k in range(0, len(whole), size))


def _ends(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _blocks() in less than half the bytes, which a writer of many parts holds in memory until its task ends.

    Rows of a part stand by word and pattern, which are moved once with the number of their rows, negative if the pattern isn't the
    word; n and held are moved where they aren't 1 and 0.
    """
    for b in batches:
        sizes = b["word"].value_lengths().to_numpy()
        cols = {c: b[c].flatten().to_numpy() for c in b.schema.names if c != "part"}
        part = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort((part << np.int64(40)) | (_mixed(cols["word"], cols["pattern"]) & np.int64((1 << 40) - 1)))
        word, pattern, part = cols["word"][order], cols["pattern"][order], part[order]
        start = np.flatnonzero(_changes(part, word, pattern))
        length = np.diff(np.r_[start, len(part)]).astype(np.int32)
        other = word[start] != pattern[start]
        n = cols["n"][order]
        odd = np.flatnonzero((n != 1) | (cols["held"][order] != 0) if "held" in cols else n != 1)
        at = (odd - (np.cumsum(sizes) - sizes)[part[odd]]).astype(np.int32)

        def lists(values: np.ndarray, of: np.ndarray, rows: int = len(sizes)) -> pa.ListArray:
            return pa.ListArray.from_arrays(_ends(np.bincount(of, minlength=rows)), pa.array(values))

        runs, odds = part[start], part[odd]
        moved = {"word": lists(word[start], runs), "pattern": lists(pattern[start][other], runs[other]), "length": lists(np.where(other, -length, length), runs)}
        moved |= {"context": lists(cols["context"][order], part), "at": lists(at, odds)}
        yield pa.RecordBatch.from_pydict({"part": b["part"], **moved, **{c: lists(cols[c][order][odd].astype(np.int32), odds) for c in ("n", "held") if c in cols}})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that _packed() got, the rows of a part in another order."""
    for b in batches:
        cols = {c: b[c].flatten().to_numpy() for c in b.schema.names if c != "part"}
        sizes = b["context"].value_lengths().to_numpy()
        length, pattern = np.abs(cols["length"]), cols["word"].copy()
        pattern[cols["length"] < 0] = cols["pattern"]
        odd = cols["at"] + np.repeat(np.cumsum(sizes) - sizes, b["at"].value_lengths().to_numpy())
        rows = {"word": np.repeat(cols["word"], length), "context": cols["context"], "pattern": np.repeat(pattern, length)}
        for c, usual in (("n", 1), ("held", 0)):
            if c in cols:
                rows[c] = np.full(len(cols["context"]), usual, np.int64)
                rows[c][odd] = cols[c]
        yield pa.RecordBatch.from_pydict({"part": b["part"], **{c: pa.ListArray.from_arrays(_ends(sizes), pa.array(v)) for c, v in rows.items()}})


def _unblocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of _blocks()."""
    for b in batches:
        yield pa.RecordBatch.from_pydict({c: b[c].flatten() for c in b.schema.names if c != "part"})


def _shape_batches(batches: Iterator[pa.RecordBatch], held: bool) -> Iterator[pa.RecordBatch]:
    """shapes_of() the rows of _blocks()."""
    yield from shapes_of(_unblocked(batches), held)


def counts_of(rows: Iterator[pa.RecordBatch], parts: int, lost: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """part, word, pattern, context, n of the rows of one task, which holds all rows of its contexts, in this order; without words that are lost."""
    t = _counted(rows, ["word", "context", "pattern"], False, rest=False)
    if t is None or not len(t):
        return
    cols = {c: t[c].to_numpy() for c in ("word", "pattern", "context", "n")}
    if lost is not None and len(lost):
        held = ~np.isin(cols["word"], lost)
        cols = {c: v[held] for c, v in cols.items()}
    order = np.lexsort([cols["context"], cols["pattern"], cols["word"]])
    cols = {c: v[order] for c, v in cols.items()}
    if not len(order):
        return
    start = np.flatnonzero(_changes(cols["word"], cols["pattern"], cols["context"]))
    sums = np.add.reduceat(cols["n"], start)
    cols = {c: cols[c][start] for c in ("word", "pattern", "context")}
    part = _part_of(_mixed(cols["word"], cols["context"]), parts)
    yield from pa.table({"part": part, **cols, "n": sums}).to_batches(max_chunksize=10_000)


def shapes_of(rows: Iterator[pa.RecordBatch], held: bool = False) -> Iterator[pa.RecordBatch]:
    """word, shape, contexts of the rows of one task, which holds all rows of its contexts."""
    t = _counted(rows, ["word", "context", "pattern"], held, rest=False)
    if t is None or not len(t):
        return
    names = ["n"] + ["held"] * held
    cols = {c: t[c].to_numpy() for c in ("word", "context", "pattern", *names)}

    def kept(rows: np.ndarray) -> None:
        cols.update({c: v[rows] for c, v in cols.items()})

    number = _mixed(cols["word"], cols["context"])
    order = np.argsort(number)
    kept(order)
    new, one = _changes(number[order]), _changes(cols["word"], cols["context"])
    if (one & ~new).any():  # two contexts with one number
        kept(np.lexsort([cols["context"], cols["word"]]))
        new = _changes(cols["word"], cols["context"])
    start = np.flatnonzero(new)
    wanted = np.add.reduceat(cols["n"], start) > 1
    if held:
        wanted |= np.add.reduceat(cols["held"], start) > 0
    if not wanted.any():
        return
    at = np.cumsum(new) - 1
    chosen = np.flatnonzero(wanted[at])  # most contexts stand once
    kept(chosen)
    at = at[chosen]
    order = np.lexsort([cols["pattern"], at])
    kept(order)
    at = at[order]
    start = np.flatnonzero(_changes(at, cols["pattern"]))
    sums = {c: np.add.reduceat(cols[c], start) for c in names}
    t = pa.table({"word": cols["word"][start], "pattern": cols["pattern"][start], **sums})
    start = np.flatnonzero(_changes(at[start]))
    size = np.diff(np.r_[start, len(t)])
    fields = ["pattern", "n"] + ["held"] * held

    def rows(parts: pa.Table, sizes: np.ndarray, contexts: np.ndarray) -> Iterator[pa.RecordBatch]:
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        shape = pa.StructArray.from_arrays([parts[f].combine_chunks() for f in fields], fields)
        whole = pa.table({"word": parts["word"].take(offsets[:-1]), "shape": pa.ListArray.from_arrays(pa.array(offsets), shape), "contexts": contexts})
        yield from whole.to_batches(max_chunksize=10_000)

    alone = t.take(start[size == 1]).group_by(["word", *fields], use_threads=False).aggregate([([], "count_all")])
    if len(alone):
        yield from rows(alone, np.ones(len(alone), np.int64), alone["count_all"].to_numpy())
    several = size > 1
    if several.any():
        yield from rows(t.filter(pa.array(np.repeat(several, size))), size[several], np.ones(several.sum(), np.int64))


def dealt_shapes(occ: DataFrame | Texts, size: int, held: str | None = None) -> DataFrame:
    """word, shape, contexts as context_shapes() has them, of the contexts that stand twice or more or have held occurrences.

    Words and patterns are 64 bits of their hashes, a context is its word and 64 bits of a hash of its neighbours. Occurrences are
    counted by the million and shuffled once, by context, in blocks of those that go to one task; each task counts its own in Arrow.
    Equal shapes of several tasks stay rows of their own. held names a boolean column.
    """
    made = f"word long, shape {_shape(held)}, contexts long"
    return _dealt_blocks(occ, max(8, -(-size // ROWS_PER_TASK)), held).mapInArrow(lambda batches: _shape_batches(_unpacked(batches), held is not None), made)


def dealt_counts(occ: DataFrame | Texts, parts: int) -> DataFrame:
    """part, word, pattern, context, n: counts of the contexts of dealt_shapes(), each in the one task that has its part."""
    return _dealt_blocks(occ, parts).mapInArrow(lambda batches: counts_of(_unblocked(_unpacked(batches)), parts), "part int, word long, pattern long, context long, n long")


def _shape(held: str | None = None) -> str:
    return f"array<struct<pattern: long, n: long{', held: long' if held else ''}>>"


def _dealt_blocks(occ: DataFrame | Texts, parts: int, held: str | None = None) -> DataFrame:
    """The _packed() blocks of occurrences, those of one part in one task."""
    more = [F.col(held).cast("long").alias("held")] if held else []
    moved = {"word": "long", "pattern": "long", "length": "int", "context": "long", "at": "int", "n": "int"} | ({"held": "int"} if held else {})
    if isinstance(occ, Texts):
        rows, each = occ.hashes(*more), _text_rows
    else:
        rows, each = occ.select(*[F.xxhash64(c).alias(c) for c in ("word", "left", "right", "pattern")], *more), _occurrence_rows
    schema = ", ".join(["part int", *[f"{c} array<{kind}>" for c, kind in moved.items()]])
    blocks = rows.mapInArrow(lambda batches: _packed(_blocks(each(batches), parts)), schema)
    return blocks.repartitionById(parts, F.col("part"))


def named_shapes(shapes: DataFrame, patterns: DataFrame, *more: str) -> DataFrame:
    """Dealt shapes with their words and patterns (word, pattern) in place of the hashes; others are left out."""
    names = patterns.select(F.xxhash64("word").alias("w"), F.xxhash64("pattern").alias("p"), F.col("word").alias("name"), F.col("pattern").alias("written"))
    parts = shapes.groupBy("word", "shape").agg(F.sum("contexts").alias("contexts")).select("*", F.explode("shape").alias("x"))
    found = parts.join(names, (F.col("word") == F.col("w")) & (F.col("x.pattern") == F.col("p")))
    back = F.array_sort(F.collect_list(F.struct(F.col("written").alias("pattern"), "x.n", *[f"x.{c}" for c in more])))  # the patterns of one context
    return found.groupBy("name", "shape", "contexts").agg(back.alias("found")).select(F.col("name").alias("word"), F.col("found").alias("shape"), "contexts")


def shapes_agreement(shapes: DataFrame) -> DataFrame:
    """agreement() of context_shapes() or dealt_shapes()."""
    ns = F.transform("shape", lambda x: x["n"])
    total = F.aggregate(ns, F.lit(0).cast("long"), lambda a, n: a + n)
    per = shapes.select("word", "contexts", total.alias("total"), F.array_max(ns).alias("best")).where("total > 1")
    return per.groupBy("word").agg(F.sum("contexts").alias("n_contexts"), F.sum(F.col("total") * F.col("contexts")).alias("n_repeated"), F.sum(F.col("best") * F.col("contexts")).alias("n_agree"))


def agreement(ctx: DataFrame) -> DataFrame:
    """word, n_contexts, n_repeated, n_agree over contexts seen more than once."""
    per = ctx.groupBy("word", "left", "right").agg(F.sum("n").alias("total"), F.max("n").alias("best")).where("total > 1")
    return per.groupBy("word").agg(F.count("*").alias("n_contexts"), F.sum("total").alias("n_repeated"), F.sum("best").alias("n_agree"))


def agreement_of(ctx: DataFrame) -> DataFrame:
    """word, n_repeated, agreement of every word of ctx: a word without a repeated context agrees fully, over none."""
    got = ctx.select("word").distinct().join(agreement(ctx), "word", "left")
    return got.select("word", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce(F.col("n_agree") / F.col("n_repeated"), F.lit(1.0)).alias("agreement"))


def pattern_counts(occ: DataFrame | Texts, **more: tuple) -> DataFrame:
    """word, pattern, n, first, example: how often each pattern stands, its first place and the form found there.

    Forms are counted first, as a hash aggregate can't hold a form, and their counts are merged. more has other aggregates by name, each
    with the function that merges its parts.
    """
    counts = [a.alias(k) for k, (a, _) in more.items()]
    if isinstance(occ, Texts):
        forms = occ.forms(*counts)
        if not (occ.pattern or occ.form):  # each pattern is one token
            return forms.withColumnRenamed("form", "example").select("word", "pattern", "n", "first", "example", *more)
    else:
        forms = occ.groupBy("word", "pattern", "form").agg(F.count("*").alias("n"), _first(occ).alias("first"), *counts)
    rows = forms.groupBy("word", "pattern").agg(F.sum("n").alias("n"), F.min(F.struct("first", "form")).alias("f"), *[merge(k).alias(k) for k, (_, merge) in more.items()])
    return rows.select("word", "pattern", "n", "f.first", F.col("f.form").alias("example"), *more)


def gated(patterns: DataFrame, gates: Gates, *more: str) -> DataFrame:
    """word, pattern, n, first, total, code and more columns of the patterns that pass all gates but that of contexts."""
    whole = Window.partitionBy("word")
    rows = patterns.select("*", F.sum("n").over(whole).alias("total"), F.count("*").over(whole).alias("raw"))
    frequent = (F.col("total") >= gates.min_word_freq) & (F.col("raw") <= gates.max_raw_patterns)
    kept = rows.where(frequent & (F.col("n") >= gates.min_pattern_count) & (F.col("n") / F.col("total") >= gates.min_pattern_frac))
    code = F.row_number().over(whole.orderBy(F.desc("n"), "first")) - 1
    return kept.withColumn("code", code).where(F.col("code") < gates.max_codes).select("word", "pattern", "n", "first", "total", "code", *more)


def refused(ctx: DataFrame, gates: Gates) -> DataFrame:
    """Words whose repeated contexts don't agree."""
    return _disagreeing(agreement(ctx), gates)


def _disagreeing(agreed: DataFrame, gates: Gates) -> DataFrame:
    return agreed.where((F.col("n_repeated") >= 2) & (F.col("n_agree") / F.col("n_repeated") < gates.min_context_agreement)).select("word")


def readings(occ: DataFrame | Texts, gates: Gates = Gates(), **more: tuple) -> tuple[DataFrame, DataFrame]:
    """The patterns that pass all gates but that of contexts, and all pattern_counts(); both are written tables."""
    patterns = materialize(pattern_counts(occ, **more), "patterns")
    return materialize(gated(patterns, gates, "example"), "readings"), patterns


def _occurrences_of(patterns: DataFrame) -> int:
    return patterns.agg(F.sum("n")).first()[0] or 0


def mine(occ: DataFrame | Texts, gates: Gates = Gates()) -> DataFrame:
    """word, code, pattern, n, example, total: the lexicon in long form, a written table with a row for each reading that passes the gates.

    Two passes over the texts. The first counts (word, pattern), combined on the map side. The second counts contexts and shuffles
    each occurrence once, as a word and a hash; which words need it is not asked before, as most occurrences belong to such words.
    """
    return mine_with_patterns(occ, gates)[0]


def mine_with_patterns(occ: DataFrame | Texts, gates: Gates = Gates(), **more: tuple) -> tuple[DataFrame, DataFrame]:
    """mine() and the pattern_counts() of the same two passes, with more aggregates."""
    kept, patterns = readings(occ, gates, **more)
    return agreeing(kept, shapes_agreement(dealt_shapes(occ, _occurrences_of(patterns))), gates), patterns


def mine_with_shapes(occ: DataFrame | Texts, held: str | None = None, gates: Gates = Gates()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """mine(), the dealt_shapes() and the pattern_counts() of the same two passes, these with the number of held ones; all are written tables."""
    kept, patterns = readings(occ, gates, **({"held": (F.count_if(held), F.sum)} if held else {}))
    shapes = materialize(dealt_shapes(occ, _occurrences_of(patterns), held), "shapes")
    return agreeing(kept, shapes_agreement(shapes), gates), shapes, patterns


def agreeing(kept: DataFrame, agreed: DataFrame, gates: Gates) -> DataFrame:
    """The lexicon, a written table: readings() without words of several patterns whose contexts don't agree, by hashes of words."""
    several = kept.where("code = 1").select("word", F.xxhash64("word").alias("w"))
    lost = several.join(materialize(_disagreeing(agreed, gates), "refused").withColumnRenamed("word", "w"), "w", "left_semi").select("word")
    return materialize(kept.join(lost, "word", "left_anti").select("word", "code", "pattern", "n", "example", "total"), "lexicon")


def coded(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """counts (word, pattern, ...) of ambiguous words with the code of each pattern, -1 where it isn't in the lexicon."""
    several = lexicon.select(F.col("word").alias("w"), F.col("pattern").alias("p"), "code", F.count("*").over(Window.partitionBy("word")).alias("codes")).where("codes > 1")
    rows = counts.join(several.select(F.col("w").alias("word")).distinct(), "word", "left_semi")
    return rows.join(several.drop("codes"), (F.col("w") == F.col("word")) & (F.col("p") == F.col("pattern")), "left").select(*counts.columns, F.coalesce("code", F.lit(-1)).alias("code"))


def labels(occ: DataFrame, lexicon: DataFrame) -> DataFrame:
    """uid, pos, word, code of occurrences of ambiguous words; -1 where the pattern isn't in the lexicon.

    The lexicon's ambiguous words are broadcast if they are few enough; else the join shuffles, and AQE splits the most frequent words.
    Counts of labels are had without it: coded().
    """
    several = lexicon.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("pattern", "code"))).alias("codes")).where(F.size("codes") > 1)
    code = F.coalesce(F.try_element_at("codes", F.col("pattern")), F.lit(-1))
    return occ.join(small_side(materialize(several, "ambiguous"), WORDS), "word").select("uid", "pos", "word", code.alias("code"))


def first_places(texts: Texts, lexicon: DataFrame, k: int) -> DataFrame:
    """word, code, k, uid, pos: the first k occurrences of each code of each ambiguous word, which is found by 64 bits of its and its pattern's hash.

    Each task keeps k of a pattern in a batch, so of frequent words little is shuffled.
    """
    schema = f"word long, pattern long, uid {texts.sentences.schema['uid'].dataType.simpleString()}, pos int"
    rows = texts.hashes(F.col("uid")).mapInArrow(lambda batches: _first_rows(batches, k), schema).withColumnsRenamed({"word": "w", "pattern": "p"})
    several = lexicon.select("word", "code", F.xxhash64("word").alias("w"), F.xxhash64("pattern").alias("p"), F.count("*").over(Window.partitionBy("word")).alias("codes")).where("codes > 1")
    order = F.row_number().over(Window.partitionBy("w", "p").orderBy("uid", "pos"))
    return rows.join(several, ["w", "p"]).withColumn("k", order).where(F.col("k") <= k).select("word", "code", "k", "uid", "pos")


def nested(lexicon: DataFrame) -> DataFrame:
    """A row for each word: patterns, counts and examples by code."""
    rows = lexicon.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("code", "pattern", "n", "example"))).alias("r"), F.first("total").alias("total"))
    return rows.select("word", F.col("r.pattern").alias("patterns"), F.col("r.n").alias("counts"), F.col("r.example").alias("examples"), "total")


def split_of(uid: Column, seed: str = "1234") -> Column:
    """Share of documents by hash: the first two hex digits of md5 decide; about 4 % dev, 4 % test."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), uid.cast("string"))), 1, 2), 16, 10).cast("int")
    return F.when(h < 10, "dev").when(h < 20, "test").otherwise("train")


def majority(occ: DataFrame) -> DataFrame:
    """word, pattern, n: each word's most frequent pattern, the first seen on ties."""
    per = occ.groupBy("word", "pattern").agg(F.count("*").alias("n"), F.min(_place(occ)).alias("first"))
    return per.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "first"))).where("r = 1").select("word", "pattern", "n")


def predict_by_neighbours(train: DataFrame, test: DataFrame) -> DataFrame:
    """uid, pos, word, pattern, guess: the most frequent pattern of the same context in train, else of the word."""
    ctx = train.groupBy("word", "left", "right", "pattern").agg(F.count("*").alias("n"))
    best = ctx.withColumn("r", F.row_number().over(Window.partitionBy("word", "left", "right").orderBy(F.desc("n"), "pattern"))).where("r = 1").select("word", "left", "right", F.col("pattern").alias("by_context"))
    alone = train.groupBy("word", "pattern").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "pattern"))).where("r = 1").select("word", F.col("pattern").alias("by_word"))
    joined = test.join(best, ["word", "left", "right"], "left").join(alone, "word", "left")
    return joined.select("uid", "pos", "word", "pattern", F.coalesce("by_context", "by_word").alias("guess"), F.col("by_word").alias("majority"))


def neighbour_scores(shapes: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """word, n, n_right, n_base: what predict_by_neighbours() gets right of each word's held-out occurrences, and its most frequent pattern alone.

    shapes have the count "held" of held-out occurrences; all others are learned from. With patterns, whose n and held count all
    occurrences, shapes without held ones may be left out.
    """
    rows = shapes.select("word", "contexts", F.transform("shape", lambda x: F.struct((x["n"] - x["held"]).alias("n"), x["pattern"].alias("pattern"), x["held"].alias("held"))).alias("s"))
    best = F.array_max(F.transform("s", lambda x: x["n"]))
    rows = rows.select("word", "contexts", "s", best.alias("best"))
    # patterns stand in order, so the first with the most occurrences is the one that ties choose
    guess = F.when(F.col("best") > 0, F.get(F.filter("s", lambda x: x["n"] == F.col("best")), F.lit(0))["pattern"])
    rows = rows.select("word", "contexts", F.explode("s").alias("x"), guess.alias("guess")).select("word", "x.*", "guess", "contexts")
    held = F.col("held") * F.col("contexts")
    right = F.when(F.col("guess") == F.col("pattern"), held).otherwise(0)
    parts = rows.select("word", "pattern", (F.col("n") * F.col("contexts")).alias("train"), held.alias("held"), right.alias("right"), F.when(F.col("guess").isNull(), held).otherwise(0).alias("open"))
    if patterns is not None:
        none = F.lit(0).cast("long")
        whole = patterns.select("word", "pattern", (F.col("n") - F.col("held")).alias("train"), "held", none.alias("right"), none.alias("open"))
        parts = parts.withColumns({"train": none, "held": none}).unionByName(whole)
    per = parts.groupBy("word", "pattern").agg(*[F.sum(c).alias(c) for c in ("train", "held", "right", "open")])
    first = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("train"), "pattern"))
    base = per.withColumn("major", (first == 1) & (F.col("train") > 0))
    right = F.col("right") + F.when(F.col("major"), F.col("open")).otherwise(0)
    return base.groupBy("word").agg(F.sum("held").alias("n"), F.sum(right).alias("n_right"), F.sum(F.when(F.col("major"), F.col("held")).otherwise(0)).alias("n_base")).where("n > 0")
