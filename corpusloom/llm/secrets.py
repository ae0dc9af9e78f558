"""Secret scans: fixed patterns, and random-looking strings by a character Markov model. DataFrame expressions only.

The model has two first-order Markov chains over characters, one for random strings and one for ordinary identifiers, both
counted on labelled samples with add-one smoothing. A candidate, a run of CANDIDATE characters, is a secret if the summed
log-likelihood ratio of the character pairs of any stretch of it passes a threshold, so a name or a path that a key is joined to
doesn't weigh against it; the candidate counts whole. The chains' ratios travel as one constant array.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, id_and_text
from ._spans import between, bind, matches, running, starts

#: Fixed values of the contract. The lengths of access and hex hold for whole runs, so the patterns can ask for them.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
LOW, SPAN = ord("+"), ord("z") - ord("+") + 1  # all candidate characters lie in this range

#: Parts of ordinary identifiers, for the labelled samples.
_PARTS = (
    "get set is has add remove update create delete find load save read write open close start stop run build parse format print "
    "user name value index count total list item node tree table column row key map file path line text word char string number date time "
    "request response server client config option default result error message handler manager factory service context session state event "
    "the and that with from this have they which their would there about other these first after where between through under another "
    "tion ment ness able ing ers est pour dans avec mente cion heit lich ung keit aux eur elle pre anti inter over under re un"
).split()


def labelled_samples(n: int = 4000, seed: int = 5) -> list[tuple[str, bool]]:
    """n random strings (true) and n ordinary identifiers, paths and long words (false), the same in every run."""
    rng = random.Random(seed)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    alphabets = [b64, b64[:62], b64[:62] + "-_", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b64[26:62]]
    out = []
    for _ in range(n):
        out.append(("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 48))), True))
        parts = rng.choices(_PARTS, k=rng.randint(3, 6))
        style = rng.randrange(6)
        word = "".join(parts) if style < 2 else rng.choice("_-/").join(parts) if style < 4 else parts[0] + "".join(p.title() for p in parts[1:]) if style == 4 else "_".join(parts).upper()
        out.append((word + (str(rng.randint(0, 2030)) if rng.random() < 0.1 else ""), False))
    return out


def train(samples: list[tuple[str, bool]]) -> list[float]:
    """log(P(next | this, random) / P(next | this, ordinary)) for all pairs, row by row."""
    counts = {kind: [[1.0] * SPAN for _ in range(SPAN)] for kind in (True, False)}
    for word, kind in samples:
        codes = [ord(c) - LOW for c in word]
        for a, b in zip(codes, codes[1:], strict=False):
            if 0 <= a < SPAN and 0 <= b < SPAN:
                counts[kind][a][b] += 1
    total = {kind: [sum(row) for row in rows] for kind, rows in counts.items()}
    return [math.log(counts[True][a][b] / total[True][a]) - math.log(counts[False][a][b] / total[False][a]) for a in range(SPAN) for b in range(SPAN)]


def ratio(word: Column, model: list[float]) -> Column:
    """Largest sum of log-likelihood ratios over a stretch of a candidate's character pairs: sum restarts where it falls below 0."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("prev"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(acc, c):
        code = F.ascii(c) - LOW
        total = F.greatest(F.lit(0.0), acc["sum"] + F.when(acc["prev"] < 0, 0.0).otherwise(F.get(table, acc["prev"] * SPAN + code)))
        return F.struct(code.alias("prev"), total.alias("sum"), F.greatest(acc["best"], total).alias("best"))

    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), start, step, lambda acc: acc["best"])


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans (start, kind, end) of a pattern's matches; keep judges each match's group."""
    found, gaps = matches(text, pattern), between(text, pattern)
    rows = F.zip_with(starts(found, gaps), found, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end")))
    if keep is not None:
        judged = F.zip_with(rows, found if group == 0 else matches(text, pattern, group), lambda r, m: F.struct(r.alias("r"), keep(m).alias("ok")))
        rows = F.transform(F.filter(judged, lambda x: x["ok"]), lambda x: x["r"])
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def scan_column(text: Column, model: list[float] | None = None, threshold: float = 10.0) -> Column:
    """All spans of a text: struct<base, markov>, arrays of (start, kind, end) by start and kind. A null text counts as empty.

    The model's spans leave out those that a base span holds whole.
    """
    text = F.coalesce(text, F.lit(""))
    model = train(labelled_samples()) if model is None else model
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, lambda m: F.length(m) >= 6, 2), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    return F.struct(base.alias("base"), _spans(text, CANDIDATE, 3, lambda m: ratio(m, model) > threshold).alias("markov"))


def _outside(s: Column) -> Column:
    return F.filter(s["markov"], lambda m: ~F.exists(s["base"], lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = 10.0) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans of every document."""
    found = id_and_text(docs).select("doc_id", scan_column(F.col("text"), model, threshold).alias("s"))
    found = found.select("doc_id", F.col("s.base").alias("base"), _outside(F.col("s")).alias("more"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", model: list[float] | None = None, threshold: float = 10.0) -> DataFrame:
    """docs with every span of a secret in text replaced by mark; overlapping spans become one. Other columns stay as they are."""
    names = [free_name(docs, n) for n in ("spans", "before")]
    spans, before = map(F.col, names)
    found = docs.withColumn(names[0], bind(scan_column(F.col("text"), model, threshold), lambda s: F.array_sort(F.concat(s["base"], _outside(s)))))
    found = found.withColumn(names[1], running(F.transform(spans, lambda x: x["end"]), F.greatest))  # where the spans before end

    def piece(x, at):
        return F.when(x["start"] >= at, F.concat(F.substring("text", at + 1, x["start"] - at), F.lit(mark))).otherwise("")

    rest = F.substring("text", F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length("text"))
    clean = F.concat(F.array_join(F.zip_with(spans, before, piece), ""), rest)
    return found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))).drop(*names)
