"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources get word targets by weight (see targets()). A source's target is met by complete epochs of all its documents first; what
is left is a weighted sample without replacement: each document draws the exponential key -ln(u) / weight from a hash of its id,
and documents are taken by rising key until the prefix sum of their sizes comes nearest to the rest. Document quality is the
weight, so better documents are more likely to be in the fraction.

No source is sorted in one task. A key falls into one of its source's bins (their number follows the source's documents); sizes
are summed by bin, prefix sums over bins find the one bin where a source's rest ends, and only that bin is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_side
from ._common import free_name

#: Fixed values of the contract.
WORD, WEIGHTS, SHARE, MOST = r"[^\x20\x09-\x0D]+", (3, 1, 2), 1.5, 2
DOCS_PER_BIN = 2000
#: Weights lie between this and 1, so that bins of keys are even.
LEAST_WEIGHT = 0.25
#: Groups that number the rows of one place.
SALTS = 64


def quality_weight(text: Column, size: Column) -> Column:
    """LEAST_WEIGHT to 1: nearer to 1 the closer a text's mean word length is to that of prose (4 to 8 characters)."""
    mean = F.length(text) / F.greatest(size, F.lit(1)) - 1
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - F.greatest(4 - mean, mean - 8, F.lit(0.0)) / 8)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, target of rows (source, size): a row for each source.

    Sources in code-point order, null last, weigh 3, 1, 2, 3, ... and share 150 % of all words. Targets stop at twice their
    source's size; the excess is shared again by weight. In order of cap / weight, the first k sources are capped for the
    smallest k at which the others' shares stay below their caps: the fixed point of sharing again and again.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(WEIGHTS)
    per = per.withColumn("w", F.get(F.array(*[F.lit(w) for w in WEIGHTS]), place)).withColumn("cap", MOST * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0))
    per = per.withColumn("level", left / weight)  # the share of weight 1 if all before this source are capped and it is not
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything)
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return per.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(first, level) * F.col("w"))).select("source", "source_size", "n_docs", "target")


def _drawn(docs: DataFrame, seed: int, weight, size_name: str, key_name: str) -> DataFrame:
    """docs with size and key, from its columns doc_id, source and text."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(mark, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    own = F.greatest(F.coalesce(weight(F.col("text"), F.col(size_name)), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    return docs.withColumn(size_name, size).withColumn(key_name, -F.log(u) / own)


def _bin(key: Column, bins: Column) -> Column:
    """Keys of weights from LEAST_WEIGHT to 1 fall into these bins evenly, up to a factor of 1 / LEAST_WEIGHT."""
    return F.least(bins - 1, F.floor((1 - F.exp(-key * LEAST_WEIGHT)) * bins))


def _place(key: Column, doc_id: Column, size: Column) -> Column:
    return F.struct(key.alias("key"), F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("doc_id"), size.alias("size"))


def plan(rows: DataFrame) -> DataFrame:
    """A written row for each source of rows (doc_id, source, size, key): its size, target, complete epochs, and where the fraction ends.

    A document is in the fraction if its bin lies below edge, or is edge and its place (key, doc_id, size) lies before cut; of the
    equal rows whose place is cut, copies are.
    """
    goals = materialize(targets(rows), "targets")
    bins = F.ceil(F.col("n_docs") / DOCS_PER_BIN).cast("long")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.select("source", "source_size", "target", bins.alias("bins"), base.alias("base"), (F.col("target") - base * F.col("source_size")).alias("rest"))
    rows = _with_source(rows.where("size > 0"), goals).withColumn("bin", _bin(F.col("key"), F.col("bins")))
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    over = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    edge = sums.where("before < rest").groupBy("source").agg(F.max(F.struct("bin", (F.col("rest") - F.col("before")).alias("rest"))).alias("e"))
    edge = materialize(edge.select("source", F.col("e.bin").alias("edge"), F.col("e.rest").alias("within")), "edges")
    # within the one bin where the rest ends: up to the prefix nearest to it, so a document is in if at least half of it fits;
    # repeated rows are counted before they are put in order
    near = _with_source(rows, edge).where("bin = edge").groupBy("source", "edge", "within", "key", "doc_id", "size").agg(F.count("*").alias("m"))
    near = near.withColumn("place", _place(F.col("key"), F.col("doc_id"), F.col("size")))
    upto = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.floor((F.col("within") - F.coalesce(F.sum(F.col("m") * F.col("size")).over(upto), F.lit(0))) / F.col("size") + 0.5)
    near = near.withColumn("copies", F.least(F.col("m"), fits)).where("copies > 0")
    cut = near.groupBy("source").agg(F.first("edge").alias("edge"), F.max(F.struct("place", "copies", "m")).alias("c"))
    cut = cut.select(F.col("source").alias("s"), "edge", F.col("c.place").alias("cut"), F.col("c.copies").alias("copies"), F.col("c.m").alias("equal"))
    return materialize(goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest"), "plan")


def _with_source(rows: DataFrame, table: DataFrame, source: str = "source") -> DataFrame:
    """rows joined with a table of one row for each source."""
    name = free_name(rows, "of_source")
    other = small_side(table.withColumnRenamed(source, name), 100_000)
    return rows.join(other, F.col("source").eqNullSafe(F.col(name))).drop(name)


def _with_epochs(rows: DataFrame, names: dict[str, str], out: str, tied: bool) -> DataFrame:
    """rows with how often each is taken; names: of size, key and the plan's columns in rows.

    tied: some cut falls between equal rows; these are then told apart by a running number, which starts from the counts of SALTS
    groups before. Those rows alone are written first.
    """
    size, key, bins, base, edge, cut, copies = (F.col(names[c]) for c in ("size", "key", "bins", "base", "edge", "cut", "copies"))
    at, place = _bin(key, bins), _place(key, F.col("doc_id"), size)
    taken = lambda inside: F.when(size > 0, F.least(F.lit(MOST), base + F.coalesce(inside, F.lit(False)).cast("long"))).otherwise(0).cast("long")
    if not tied:
        return rows.withColumn(out, taken((at < edge) | ((at == edge) & (place <= cut))))
    is_cut = F.coalesce(place == cut, F.lit(False))
    sure = rows.where(~is_cut).withColumn(out, taken((at < edge) | ((at == edge) & (place < cut))))
    mark, salt, before = (free_name(rows, n) for n in ("row_mark", "row_salt", "rows_before"))
    # written, as the numbers of a task that runs again could differ from those that were counted
    same = materialize(rows.where(is_cut).withColumn(mark, F.monotonically_increasing_id()), "ties")
    same = same.withColumn(salt, F.pmod(F.xxhash64(mark), F.lit(SALTS)))
    counts = same.groupBy("source", salt).agg(F.count("*").alias("c"))  # SALTS rows for each source at most
    order = Window.partitionBy("source").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    name = free_name(same, "of_source")
    counts = counts.select(F.col("source").alias(name), F.col(salt).alias(salt + "_"), F.coalesce(F.sum("c").over(order), F.lit(0)).alias(before))
    same = same.join(counts, F.col("source").eqNullSafe(F.col(name)) & (F.col(salt) == F.col(salt + "_")))
    number = F.col(before) + F.row_number().over(Window.partitionBy("source", salt).orderBy(mark))
    same = same.withColumn(out, taken(number <= copies)).drop(mark, salt, salt + "_", before, name)
    return sure.unionByName(same)


def _tied(goals: DataFrame) -> bool:
    return goals.where("copies < equal").limit(1).count() > 0


def _sizes(docs: DataFrame, seed: int, weight) -> DataFrame:
    """doc_id, source, size, key of every document, written: texts are read once, what follows reads four narrow columns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return materialize(_drawn(rows, seed, weight, "size", "key").drop("text"), "mix")


def mix(docs: DataFrame, seed: int = 17, weight=quality_weight) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken of every document: the mix takes taken = epochs * size words of it.

    Whole documents are taken, so a source's words come as near to its target as its documents' sizes allow. A null text has
    size 0 and takes nothing. Keys are drawn from a row's id and text; where equal rows stand at the end of the fraction, as many of
    them are taken as fit. The same rows give the same mix in every run. Weights below LEAST_WEIGHT count as that.
    """
    rows = _sizes(docs, seed, weight)
    goals = plan(rows)
    rows = _with_epochs(_with_source(rows, goals), {c: c for c in ["size", "key", *goals.columns]}, "epochs", _tied(goals))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 17, weight=quality_weight) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, with all their columns. Texts aren't shuffled."""
    cuts = plan(_sizes(docs, seed, weight))
    names = {c: free_name(docs, f"plan_{c}") for c in ["size", "key", *cuts.columns]}
    rows = _drawn(docs, seed, weight, names["size"], names["key"])
    rows = _with_source(rows, cuts.toDF(*[names[c] for c in cuts.columns]), names["source"])
    epochs = free_name(rows, "plan_epochs")
    rows = _with_epochs(rows, names, epochs, _tied(cuts)).where(F.col(epochs) > 0)
    return rows.withColumn(names["size"], F.explode(F.sequence(F.lit(1), F.col(epochs).cast("int")))).select(*docs.columns)
