"""Fill-in-middle by relational units: pieces are exploded, windows sum their units and lengths, cuts are joined by unit ordinal.

A unit is a run of ASCII letters or one other character. A text is exploded into pieces of about PIECE characters that end where
a unit ends; a window over each document's pieces adds up their units and lengths, the two cut requests of a document meet
the piece in which their unit ordinal falls, and the offsets are gathered in one row for each document. Only then do texts
move: each is joined with its row and cut by substring. Exploding single units would sort some 400 rows
for each kilobyte of text, more bytes than the text has; of pieces there are about 4, and the last step finds the unit in its piece.

Documents are told apart by id and text, so rows that repeat share one set of offsets and all come back. A null text is empty; an
empty text has no units and stays plain. A null id draws as the empty string would. All functions are native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PIECE = 256
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 that follow from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _key(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)))


def runs(docs: DataFrame) -> DataFrame:
    """For each piece of each different document: its place p, the units and characters before it (u0, c0), its own (units, chars), and the document's n."""
    piece = docs.select("k", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"[\\s\\S]{{1,{PIECE}}}[A-Za-z]*"), F.lit(0))).alias("p", "piece"))
    sizes = piece.select("k", "doc_id", "p", F.length(F.regexp_replace("piece", "[A-Za-z]+", "a")).cast("long").alias("units"), F.length("piece").cast("long").alias("chars"))
    once = sizes.groupBy("k", "p").agg(F.max("doc_id").alias("doc_id"), F.max("units").alias("units"), F.max("chars").alias("chars"))
    own = Window.partitionBy("k")
    before = own.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return once.select("*", total("units").alias("u0"), total("chars").alias("c0"), F.sum("units").over(own).alias("n"))


def offsets(pieces: DataFrame, seed: int = 1) -> DataFrame:
    """One row for each document: k, n, and for either cut the piece it falls in and how many of its units stand before the cut."""
    h1, h2 = draws(F.col("doc_id"), seed)[:2]
    n = F.col("n")
    asked = pieces.where("p = 0").select("k", "n", F.array(F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))).alias("cuts"))
    asked = asked.select("k", "n", F.posexplode("cuts").alias("which", "ordinal"))
    at = pieces.select(F.col("k").alias("pk"), "u0", "c0", "units", "chars")
    inside = (F.col("k") == F.col("pk")) & (F.col("u0") < F.col("ordinal")) & (F.col("ordinal") <= F.col("u0") + F.col("units"))
    hit = asked.join(at, inside, "left")  # the cut before the first unit falls in no piece
    place = F.struct("c0", "chars", (F.col("ordinal") - F.col("u0")).alias("within"))
    cut = lambda w: F.max(F.when((F.col("which") == w) & F.col("c0").isNotNull(), place))
    return hit.groupBy("k").agg(F.max("n").alias("n"), cut(0).alias("first"), cut(1).alias("second"))


def _offset(text: Column, cut: Column) -> Column:
    """Characters before a cut: those before its piece, and the units of the piece that stand before it."""
    piece = F.substring(text, (cut["c0"] + 1).cast("int"), cut["chars"].cast("int"))
    ahead = F.array_join(F.slice(F.regexp_extract_all(piece, F.lit(UNIT), F.lit(0)), F.lit(1), cut["within"].cast("int")), "")
    return F.when(cut.isNull(), F.lit(0)).otherwise((cut["c0"] + F.length(ahead)).cast("int"))


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars, output of every row of docs; its other columns are left out.

    Of a hundred documents rate are cut, and of a hundred of those spm_rate put the suffix first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("k", _key(F.col("doc_id"), F.col("text")))
    cuts = offsets(materialize(runs(rows), "pieces"), seed).withColumnRenamed("k", "ck")
    _, _, h3, h4 = draws(F.col("doc_id"), seed)
    t = F.col("text")
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = F.when((t == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    out = rows.join(cuts, F.col("k") == F.col("ck"), "left").select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), "first", "second")
    plain = F.col("form") == "plain"
    out = out.withColumn("a", F.when(~plain, _offset(t, F.col("first")))).withColumn("b", F.when(~plain, _offset(t, F.col("second"))))
    a, b = F.col("a"), F.col("b")
    prefix, middle, suffix = F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, F.length(t))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(plain, t).when(F.col("form") == "spm", spm).otherwise(psm)
    return out.select("doc_id", "text", "n", "form", a.cast("long").alias("prefix_chars"), (b - a).cast("long").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that transform() was given, from its output and form alone. No mark can begin in one part and end in another."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # what stands before the first mark is empty
    first, second, last = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "spm", F.concat(second, last, first)).otherwise(F.concat(first, last, second))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
