"""Chat formatting: conversations as budgeted windows of a marked template, with spans of text to learn from. DataFrame expressions only.

A turn is START role, a line break, the text, END and a line break. Control strings that stand inside a text or a role get one
backslash after their first character (one more if there are some already), so none of them can be taken for the template's
own and taking away one backslash restores the text.

Prefix sums of the turns' tokens choose the windows: a turn belongs to window floor(tokens before it / span), so windows are
turn-aligned, and no turn is split or dropped. A system turn that opens the conversation is retained in every window and charged
to it: the span is span_tokens less the system turn's tokens, but a quarter of span_tokens at least, as a long system turn would
leave no room for others. The turns just before a window that fit into history_tokens are repeated at its head. Only assistant
texts that are new in a window are under its loss mask, so each is learnt from once.

A window holds at most max(span_tokens, system turn + span_tokens / 4) + history_tokens tokens, and what its last turn has beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TAIL = r"\|(?:im_start|im_end|endoftext|startoftext|system|user|assistant|end)\|>|/?s>|/?INST\]|</?SYS>>"
ESCAPE, UNESCAPE = rf"([<\[])(\\*)({_TAIL})", rf"([<\[])\\(\\*)({_TAIL})"
#: What counts as a token for the budget, and what a turn's marks cost.
TOKEN, MARKS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _plain_role(role: Column) -> Column:
    marked = F.replace(unescape(role), F.lit("\\\\"), F.lit("\0"))
    return F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))


def format_windows(turns: DataFrame, span_tokens: int = 768, history_tokens: int = 192) -> DataFrame:
    """Windows (conv_id, window, text, n_turns, n_repeated, loss) of rows (conv_id, turn, role, text).

    loss: array of (start, length) code points. The first n_repeated turns of a window stand in an earlier one. Null texts and
    roles count as empty; rows without a conv_id form one conversation; equal turns are ordered by role and text; other columns
    are left out.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head, body = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("own", F.regexp_count("text", F.lit(TOKEN)) + MARKS)
    rows = rows.withColumn("tokens", F.when(F.col("is_system"), 0).otherwise(F.col("own")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("tokens").over(upto) - F.col("tokens"))
    rows = rows.withColumn("piece", F.concat(head, body, F.lit(f"{END}\n"))).withColumn("head", F.length(head)).withColumn("body", F.length(body))
    rows = rows.withColumn("system", F.first(F.when(F.col("is_system"), F.col("piece")), ignorenulls=True).over(upto))
    charged = F.coalesce(F.first(F.when(F.col("is_system"), F.col("own")), ignorenulls=True).over(upto), F.lit(0))
    rows = rows.withColumn("span", F.greatest(F.lit(span_tokens) - charged, F.lit(-(-span_tokens // 4))))
    rows = rows.withColumn("window", F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.floor(F.col("start") / F.col("span")))))
    following = Window.partitionBy("conv_id").orderBy("window").rangeBetween(1, 1)
    rows = rows.withColumn("next", F.min("start").over(following))
    repeats = ~F.col("is_system") & (F.col("next") - F.col("start") <= history_tokens)
    place = F.when(repeats, F.array(F.col("window"), F.col("window") + 1)).otherwise(F.array("window"))
    rows = rows.withColumn("at", F.explode(place)).withColumn("new", F.col("at") == F.col("window"))
    turn = F.struct("pos", "new", "is_system", "piece", "head", "body", (F.col("role") == "assistant").alias("learn"))
    got = rows.groupBy("conv_id", F.col("at").alias("window")).agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max("system").alias("system"))
    got = got.withColumn("prefix", F.when(F.get("turns", F.lit(0))["is_system"], "").otherwise(F.coalesce("system", F.lit(""))))
    empty = F.struct(F.length("prefix").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))

    def step(acc, t):
        own = F.array(F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length")))
        spans = F.when(t["new"] & t["learn"], F.concat(acc["out"], own)).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(t["piece"])).alias("at"), spans.alias("out"))

    repeated = (F.col("prefix") != "").cast("int")
    return got.select(
        "conv_id", "window",
        F.concat("prefix", F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("text"),
        (F.size("turns") + repeated).alias("n_turns"),
        (F.size(F.filter("turns", lambda t: ~t["new"])) + repeated).alias("n_repeated"),
        F.aggregate("turns", empty, step, lambda acc: acc["out"]).alias("loss"),
    )


def parse_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted window."""
    parts = F.split(text, r"<\|im_start\|>")
    whole = F.slice(parts, 2, F.size(parts))

    def one(p):
        cut = F.locate("\n", p)
        return F.struct(_plain_role(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(p, cut + 1, F.length(p) - cut - len(END) - 1)).alias("text"))

    return F.transform(whole, one)


def learnt(text: Column, loss: Column) -> Column:
    """The texts under a window's loss mask, as they were before escaping."""
    return F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"])))


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, all read from the windows."""
    new = F.slice(parse_turns(F.col("text")), F.col("n_repeated") + 1, F.col("n_turns"))
    said = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = windows.select("conv_id", F.struct("window", said.alias("turns"), F.array_join(learnt(F.col("text"), F.col("loss")), "").alias("loss")).alias("w"), F.size(new).alias("n"), F.length("text").alias("chars"))
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    joined = lambda field: F.array_join(F.transform("ws", lambda w: w[field]), "")
    got = got.select("*", joined("turns").alias("said"), joined("loss").alias("taught"))
    return got.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("taught").cast("long").alias("loss_chars"), F.sha2("taught", 256).alias("loss_sha256"), "formatted_chars", "n_windows")
