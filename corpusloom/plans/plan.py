"""Reading plans: for each word of a text its readings, the one chosen, and how hard the text is. A plan is a table with a row for each word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars, marks, vocab
from ..operators import numeric
from .config import Inference


def first(*values):
    """The first that isn't None: call, plan, configuration."""
    return next((v for v in values if v is not None), None)


def analyze(texts: DataFrame, lexicon: DataFrame, scores: DataFrame | None = None, marked: DataFrame | None = None) -> DataFrame:
    """uid, idx, word, identity, n_codes, code, probs, difficulty, from_user of rows (uid, text).

    lexicon: nested readings (word, patterns, ...); a word outside it has one code. scores (uid, idx, logits array<double>) choose
    codes; without them the shares of the lexicon's counts do. marked (uid, idx, code) are the user's choices: valid ones win.
    """
    words = texts.select("uid", F.posexplode(chars.words(F.col("text"))).alias("idx", "word")).withColumn("identity", chars.word_identity(F.lower("word")))
    rows = words.join(lexicon.select(F.col("word").alias("identity"), F.size("patterns").alias("k"), "counts"), "identity", "left").withColumn("n_codes", F.coalesce("k", F.lit(1)))
    logits = F.transform(F.coalesce("counts", F.array(F.lit(1).cast("long"))), lambda c: F.log(c.cast("double")))
    if scores is not None:
        rows = rows.join(scores, ["uid", "idx"], "left")
        logits = F.coalesce("logits", logits)
    rows = rows.withColumn("probs", numeric.masked_softmax(logits, F.col("n_codes")))
    rows = rows.withColumn("difficulty", numeric.entropy(F.col("probs"), F.col("n_codes"))).withColumn("model_code", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
    if marked is not None:
        rows = rows.join(marked.select("uid", "idx", F.col("code").alias("asked")), ["uid", "idx"], "left")
    else:
        rows = rows.withColumn("asked", F.lit(None).cast("int"))
    valid = F.coalesce(F.col("asked").between(0, F.col("n_codes") - 1), F.lit(False))
    return rows.select("uid", "idx", "word", "identity", "n_codes", F.when(valid, F.col("asked")).otherwise(F.col("model_code")).alias("code"), "probs", F.when(valid, 0.0).otherwise(F.col("difficulty")).alias("difficulty"), valid.alias("from_user"))


def set_code(plan: DataFrame, uid, idx: int, code: int) -> DataFrame:
    """The plan with another code for one word; codes outside its readings change nothing."""
    here = (F.col("uid") == uid) & (F.col("idx") == idx) & F.lit(code).between(0, F.col("n_codes") - 1)
    return plan.withColumn("code", F.when(here, code).otherwise(F.col("code"))).withColumn("from_user", F.col("from_user") | here)


def set_reading(plan: DataFrame, lexicon: DataFrame, uid, idx: int, pattern: str) -> DataFrame:
    """The plan with the reading of a pattern for one word, if the word has it."""
    rows = plan.join(lexicon.select(F.col("word").alias("identity"), (F.array_position("patterns", F.lit(pattern)) - 1).cast("int").alias("__c")), "identity", "left")
    here = (F.col("uid") == uid) & (F.col("idx") == idx) & F.coalesce(F.col("__c") >= 0, F.lit(False))
    return rows.withColumn("code", F.when(here, F.col("__c")).otherwise(F.col("code"))).withColumn("from_user", F.col("from_user") | here).select(*plan.columns)


def hard_words(plan: DataFrame) -> DataFrame:
    return plan.where("n_codes > 1")


def complexity(plan: DataFrame, knobs: Inference = Inference(), budget: float = 1.0, force_depth: int | None = None) -> DataFrame:
    """uid, n_words, n_hard, difficulty, depth of each text."""
    if not 0 < budget <= 1:
        raise ValueError("a budget lies in (0, 1]")
    per = plan.groupBy("uid").agg(F.count("*").alias("n_words"), F.count_if(F.col("n_codes") > 1).alias("n_hard"), numeric.pooled_difficulty(F.col("difficulty")).alias("difficulty"))
    exits = tuple(knobs.exits)
    depth: Column = numeric.depth_for(F.col("difficulty"), exits, knobs.tau_low, knobs.tau_high)
    forced = first(force_depth, knobs.force_depth)
    return per.withColumn("depth", numeric.budget_depth(F.lit(forced) if forced is not None else depth, F.lit(budget), exits))


def hardest(plan: DataFrame, n: int = 10) -> DataFrame:
    """The n hardest words of each text, in order."""
    order = Window.partitionBy("uid").orderBy(F.desc("difficulty"), "idx")
    return plan.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def complexity_table(plan: DataFrame, knobs: Inference = Inference()) -> DataFrame:
    """uid, index, word, readings, code, confidence, difficulty, depth, source: the depth is the one that a word alone would ask for."""
    several = F.col("n_codes") > 1
    source = F.when(F.col("from_user"), "user").when(several, "model").otherwise("unambiguous")
    depth = numeric.depth_for(F.col("difficulty"), tuple(knobs.exits), knobs.tau_low, knobs.tau_high)
    confidence = F.get("probs", F.col("code").cast("int"))
    return plan.select(
        "uid", F.col("idx").alias("index"), "word", F.col("n_codes").alias("readings"), F.when(several, F.col("code")).alias("code"),
        F.when(several, confidence).alias("confidence"), "difficulty", depth.alias("depth"), source.alias("source"),
    )


def _fill(c: Column, width: int, right: bool = True) -> Column:
    """A string with spaces before or behind it up to a width; longer ones stay whole."""
    c = c.cast("string")
    spaces = F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(c)))
    return F.concat(spaces, c) if right else F.concat(c, spaces)


def complexity_report(plan: DataFrame, texts: DataFrame, per: DataFrame, unresolved: DataFrame | None = None, knobs: Inference = Inference()) -> DataFrame:
    """uid, report: the complexity table of each text (uid, text) as lines, hardest words first.

    per: complexity(plan). unresolved (uid, idx, reason) names words whose marks could not be applied.
    """
    fixed = lambda c: F.format_string("%.3f", F.col(c))
    line = F.concat(
        _fill(F.col("index"), 3), F.lit("  "), _fill(F.col("word"), 16, False), _fill(F.col("readings"), 5), _fill(fixed("difficulty"), 8), _fill(F.col("depth"), 7),
        _fill(F.when(F.col("confidence").isNull(), "-").otherwise(fixed("confidence")), 8), F.lit("  "), F.col("source"),
    )
    table = complexity_table(plan, knobs).select("uid", F.struct((-F.col("difficulty")).alias("d"), F.col("index").alias("i"), line.alias("line")).alias("x"))
    lines = table.groupBy("uid").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # the words of one text
    # The report's headings.
    head = F.concat(_fill(F.lit("#"), 3), F.lit("  "), _fill(F.lit("word"), 16, False), _fill(F.lit("read"), 5), _fill(F.lit("diff"), 8), _fill(F.lit("depth"), 7), _fill(F.lit("conf"), 8), F.lit("  source"))
    title = F.concat(F.lit("sentence difficulty "), fixed("difficulty"), F.lit(" -> depth "), F.col("depth").cast("string"))
    parts = F.concat(F.array(F.concat(F.lit("text: "), F.col("text")), title, F.lit(""), head, F.lit("-" * 62)), F.transform("xs", lambda x: x["line"]))
    rows = texts.join(per, "uid").join(lines, "uid")
    if unresolved is not None:
        named = unresolved.where("reason is not null").join(plan.select("uid", "idx", "word"), ["uid", "idx"], "left")
        said = F.concat(F.lit("  "), F.coalesce("word", F.concat(F.lit("#"), F.col("idx").cast("string"))), F.lit(": "), F.col("reason"))
        named = named.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("idx", said.alias("line")))).alias("ms"))
        rows = rows.join(named, "uid", "left")
        lost = F.transform("ms", lambda x: x["line"])
        parts = F.when(F.col("ms").isNull(), parts).otherwise(F.concat(parts, F.array(F.lit(""), F.lit("diacritics that could not be applied:")), lost))
    return rows.select("uid", F.array_join(parts, "\n").alias("report"))


def to_dict(plan: DataFrame, texts: DataFrame, per: DataFrame) -> DataFrame:
    """uid, text, sentence_difficulty, depth, words, overrides: a plan as one nested row for each text, ready for JSON."""
    word = F.struct(F.col("idx").alias("index"), "word", "n_codes", "code", F.get("probs", F.col("code").cast("int")).alias("confidence"), "difficulty", "probs")
    taken = F.collect_list(F.when(F.col("from_user"), F.struct(F.col("idx").cast("string").alias("key"), F.col("code").alias("value"))))
    words = plan.groupBy("uid").agg(F.array_sort(F.collect_list(word)).alias("words"), F.map_from_entries(F.array_sort(taken)).alias("overrides"))  # one text
    return texts.join(per, "uid").join(words, "uid").select("uid", "text", F.col("difficulty").alias("sentence_difficulty"), "depth", "words", "overrides")


def prepare_inputs(texts: DataFrame, lexicon: DataFrame, ids: dict[str, int], strip_marks: bool = True, lower: bool = True, fold_alef: bool = False, digits: bool = True) -> DataFrame:
    """uid, text, words, ids, word_index, n_codes, variants of rows (uid, text); texts without a word are left out.

    A user's marks are read before normalisation takes them: their variants stay only where it keeps the text's length.
    """
    bare = chars.strip_label_marks(F.col("text"))
    found = marks.letter_variants(marks.normalize_variant_marks(F.col("text")))
    clean = chars.normalize_composed(F.col("bare"), strip_marks=strip_marks, lower=lower, fold_alef=fold_alef, digits=digits)
    rows = texts.select("uid", bare.alias("bare"), found.alias("found"))
    rows = chars.with_composed(rows, "bare").select("uid", clean.alias("text"), F.length("bare").alias("n"), "found")
    rows = rows.withColumn("spans", chars.word_spans(F.col("text"))).where(F.size("spans") > 0)
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    kept = F.when(F.length("text") == F.col("n"), F.col("found"))
    rows = rows.select("uid", "text", "spans", vocab.encode_with_word_index(F.col("text"), F.col("spans"), table).alias("e"), vocab.row_variants(F.col("text"), kept).alias("variants"))
    known = lexicon.select(F.col("word").alias("identity"), F.size("patterns").alias("k"))
    each = rows.select("uid", F.posexplode("spans").alias("idx", "s")).select("uid", "idx", chars.word_identity(F.lower("s.word")).alias("identity"))
    each = each.join(known, "identity", "left").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("k", F.lit(1)).alias("k")))).alias("ks"))  # one text
    return rows.join(each, "uid").select(
        "uid", "text", F.transform("spans", lambda s: s["word"]).alias("words"), F.col("e.ids").alias("ids"), F.col("e.word_index").alias("word_index"),
        F.transform("ks", lambda x: x["k"]).alias("n_codes"), "variants",
    )


#: Where the knobs of a request may lie.
RANGES = {"tempo": (0.25, 4.0), "cfg": (0.0, 10.0), "temperature": (0.0, 2.0)}


def checked_knobs(**knobs: float) -> dict[str, float]:
    """The knobs, if each lies in its range and a budget in (0, 1]; else an error."""
    for name, value in knobs.items():
        if name == "budget":
            if not 0 < value <= 1:
                raise ValueError("a budget lies in (0, 1]")
        elif not RANGES[name][0] <= value <= RANGES[name][1]:
            raise ValueError(f"{name} lies from {RANGES[name][0]} to {RANGES[name][1]}, not at {value}")
    return knobs
