"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by MinHash banding.

1. Each text becomes a set of 64-bit shingle hashes (lower-cased words between ASCII spaces; a text of 1 to 4 words is one
   shingle), a digest of that set and MinHash bands. Band and row counts follow from the recall wanted at the threshold.
2. Equal sets are one vertex that knows its members. Only vertices shuffle on band hashes.
3. Buckets of at most SMALL vertices give candidate pairs, one each however many bands agree, verified on the full sets.
4. Larger buckets give no pairs: those that share vertices form a cluster, which is compared all against all in blocks, each
   block pair once, with exact intersection counts as matrix products. A block pair returns a row for each vertex, the number
   of documents it is linked to and the least vertex it is connected with, so rows stay linear in a cluster's size. Only pairs
   that share a band count there too, so links don't depend on how many vertices stand in a bucket.
5. Connected components of all links are the classes.

No candidate is dropped or capped. Links between different texts are found with the bands' recall, links of equal sets always.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, small_side
from ._common import free_name, id_and_text, slices

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
SMALL = 16
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_500_000
BROADCAST = 200_000  # rows of two or three short columns
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest false candidates, that reach the recall at the threshold with max_hashes hashes.

    Raises if no plan does.
    """
    best = None
    for rows in range(1, 65):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-min(threshold**rows, 1 - 1e-12)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{max_hashes} hashes can't reach a recall of {recall} at {threshold}")
    return best


_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    if len(_words) > 200_000:
        _words.clear()
    out = list(map(_words.get, words))
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = xxhash.xxh64_intdigest(words[i])
                if len(words[i]) <= 64:  # so the cache is bounded in bytes too
                    _words[words[i]] = out[i]
    return np.fromiter(out, np.uint64, len(out))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Bands:
    """MinHash bands of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.shape = (bands, rows)
        self.a = rng.integers(0, 1 << 31, (bands * rows, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        x = (own ^ own >> np.uint64(32)).astype(np.uint32)[None]
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, x.shape[1], 2048):
            least = np.minimum(least, (self.a * x[:, at : at + 2048] + self.b).min(1))
        rows = least.reshape(self.shape).astype(np.uint64)
        out = np.arange(self.shape[0], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for col in rows.T:
            out = (out ^ col) * _MIX
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def signatures(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS) -> DataFrame:
    """doc_id, digest, n, bands of every document. Texts without a word have a null digest and no bands."""
    plan = band_plan(threshold, recall)

    def run(batches):
        band = Bands(*plan)
        for part in slices(batches):
            sets = [shingles(t, n) for t in part.column("text").to_pylist()]
            columns = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([band(s) if len(s) else None for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "digest", "n", "bands"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, digest binary, n int, bands array<long>")


def vertex_of(first_id: Column, digest: Column) -> Column:
    """A vertex's name: 25 bytes that sort by the least id of its documents (none last), then by its digest."""
    place = F.lpad(F.hex(first_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.concat(F.when(first_id.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), place)), F.hex(digest)))


def least_id(vertex: Column) -> Column:
    """The id in a vertex's name, or null."""
    place = F.conv(F.hex(F.substring(vertex, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(vertex, 1, 1)) == "00", place.cast("long"))


def _vertex(doc_id: int | None, digest: bytes) -> bytes:
    return (b"\x01" + bytes(8) if doc_id is None else b"\x00" + (doc_id + (1 << 63)).to_bytes(8, "big")) + digest


def _sets(docs: DataFrame, vertices: DataFrame, n: int) -> DataFrame:
    """vertex, shingles of these vertices (vertex, first_id), from the documents with their first_ids; repeated rows give repeated rows."""

    def run(batches):
        for part in slices(batches):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            sets = [(i, s) for i, t in zip(ids, texts, strict=True) if len(s := shingles(t, n))]
            names = [_vertex(i, _digest(s)) for i, s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([s.view(np.int64) for _, s in sets], pa.list_(pa.int64()))], ["vertex", "shingles"])

    source, kind = id_and_text(docs), "vertex binary, shingles array<long>"
    wanted = materialize(vertices.where("first_id is not null").select("first_id").distinct(), "ids")
    found = source.join(small_side(wanted, 1_000_000), source["doc_id"] == wanted["first_id"], "left_semi").mapInArrow(run, kind)
    nameless = vertices.where("first_id is null").select("vertex")
    return found.unionByName(source.where("doc_id is null").mapInArrow(run, kind).join(nameless, "vertex", "left_semi"))


def intersections(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[first] with sets[second].

    Elements of many sets are counted by matrix products over slices of them, those of few sets pair by pair.
    """
    size, owner = len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((len(first), len(second)), np.float32)
    many = np.flatnonzero(freq > 16)
    column = np.full(len(freq), -1)
    column[many] = np.arange(len(many))
    col = column[code]
    use = col >= 0
    col, row = col[use], owner[use]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for at in range(0, len(many), 4096):
        a, b = np.searchsorted(col, [at, at + 4096])
        x = np.zeros((size, min(4096, len(many) - at)), np.float32)
        x[row[a:b], col[a:b] - at] = 1
        out += x[first] @ x[second].T
    order = np.argsort(code, kind="stable")
    starts = np.concatenate([[0], freq.cumsum()[:-1]])
    pairs = []
    for k in range(2, 17):
        at = starts[freq == k]
        if len(at):
            rows = owner[order[at[:, None] + np.arange(k)]]
            pairs += [rows[:, p] * size + rows[:, q] for p in range(k) for q in range(k) if p != q]
    if pairs:
        few = np.bincount(np.concatenate(pairs), minlength=size * size).reshape(size, size)
        out += few[np.ix_(first, second)]
    return out


_BLOCK_OUT = "vertex binary, low binary, links long"


def _compare(threshold: float):
    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        rows: dict[bytes, tuple] = {}
        whole = [table.column(c) for c in ("shingles", "bands")]
        for d, m, b, *lists in zip(*(table.column(c).to_pylist() for c in ("vertex", "members", "block")), *whole, strict=True):
            rows.setdefault(d, (m, b, *(x.values.to_numpy(zero_copy_only=False) for x in lists)))
        names = sorted(rows)
        members, block = (np.array([rows[d][k] for d in names]) for k in (0, 1))
        sets = [rows[d][2] for d in names]
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found: list = [[], [], []]
        if len(first) and len(second):
            lengths, near = np.array([len(s) for s in sets]), intersections(sets, first, second)
            linked = near / (lengths[first][:, None] + lengths[second][None] - near) >= threshold - 1e-7
            bands = np.array([rows[d][3] for d in names])
            shared = np.zeros_like(linked)
            for own, other in zip(bands[first].T, bands[second].T, strict=True):
                shared |= own[:, None] == other[None]
            linked &= shared
            if i == j:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(names), np.int64)
            links[first] += linked @ members[second]
            if i != j:
                links[second] += members[first] @ linked
            label = np.arange(len(names))
            while True:
                old = label.copy()
                top = len(names)
                np.minimum.at(label, first, np.where(linked, label[second][None], top).min(1))
                np.minimum.at(label, second, np.where(linked, label[first][:, None], top).min(0))
                label = label[label]
                if (label == old).all():
                    break
            for v in np.flatnonzero(links):
                for out, x in zip(found, (names[v], names[label[v]], int(links[v])), strict=True):
                    out.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["vertex", "low", "links"])

    return run


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """vertex, component (its least vertex) of the vertices of edges, by least labels of neighbours and jumps to labels' labels.

    Each round is a written table, so lost executors repeat one round at most.
    """
    both = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("vertex"), F.least("u", "m").alias("component")), "labels")
    while True:
        side = lambda df, a, b: small_side(df.select(F.col("vertex").alias(a), F.col("component").alias(b)), BROADCAST)
        near = both.join(side(labels, "v", "c"), "v").groupBy("u").agg(F.min("c").alias("near"))
        new = labels.join(near, F.col("vertex") == F.col("u")).select("vertex", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        new = materialize(new, "labels")
        jumped = new.join(side(new, "w", "c"), F.col("component") == F.col("w"), "left")
        jumped = jumped.select("vertex", F.least("component", F.coalesce("c", "component")).alias("component"), "old")
        jumped = materialize(jumped, "labels")
        if jumped.where("component <> old").limit(1).count() == 0:
            return jumped.select("vertex", "component")
        labels = jumped.select("vertex", "component")


def join_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, digest, component: a row for each row of docs.

    class_id is the least doc_id of the document's class, n_links the number of other documents that it is linked to directly,
    n_copies that of documents with the same shingle set. Documents without a word are classes of their own; a class whose
    documents all lack an id has a null class_id. component names the class whatever its ids; it is null for texts without a word.
    """
    sig = materialize(signatures(docs, threshold, recall, n), "signatures")
    vertices = sig.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("members"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    vertices = materialize(vertices.withColumn("vertex", vertex_of(F.col("first_id"), F.col("digest"))), "vertices")
    rows = vertices.select("vertex", "n", F.explode("bands").alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("vertex").alias("low")).where("size > 1")
    hits = materialize(rows.join(counts, "bucket"), "hits")
    facts = vertices.select("vertex", "members", "first_id", "n")
    candidates = facts.join(hits.select("vertex").distinct(), "vertex", "left_semi")
    sets = materialize(_sets(docs, candidates, n), "sets")

    clusters = components(hits.where(F.col("size") > SMALL).select("vertex", "low"), "vertex", "low")
    linked = materialize(_small_buckets(hits.where(F.col("size") <= SMALL), sets, clusters, threshold), "linked")
    compared = materialize(_clusters(clusters, vertices.select("vertex", "members", "n", "bands"), sets, threshold), "compared")

    weights = lambda name: facts.select(F.col("vertex").alias(name), F.col("members").alias("links"))
    links = linked.join(weights("b"), "b").select(F.col("a").alias("vertex"), "links")
    links = links.unionByName(linked.join(weights("a"), "a").select(F.col("b").alias("vertex"), "links"))
    links = links.unionByName(compared.select("vertex", "links")).groupBy("vertex").agg(F.sum("links").alias("links"))
    found = components(linked.unionByName(compared.select(F.col("vertex").alias("a"), F.col("low").alias("b"))))
    # a component is named by its least vertex, so its name holds its least id: nothing is joined on components
    told = vertices.select("digest", "vertex", "members").join(found, "vertex", "left").join(links, "vertex", "left")
    component = F.coalesce("component", "vertex")
    n_links = F.coalesce("links", F.lit(0)) + F.col("members") - 1
    told = told.select("digest", component.alias("component"), n_links.alias("n_links"), F.col("members").alias("n_copies"))
    told = materialize(told.withColumn("class_id", least_id(F.col("component"))), "classes")
    out = sig.select("doc_id", "digest").join(small_side(told, BROADCAST), "digest", "left")
    class_id = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    number = lambda c, none: F.coalesce(c, F.lit(none)).cast("long").alias(c)
    return out.select("doc_id", class_id.alias("class_id"), number("n_links", 0), number("n_copies", 1), "digest", "component")


def _small_buckets(hits: DataFrame, sets: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """Linked pairs (a, b) of buckets of SMALL vertices at most; equal lists of several bands count once."""
    inside = lambda v, c: small_side(clusters.select(F.col("vertex").alias(v), F.col("component").alias(c)), BROADCAST)
    lists = hits.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("vertex", "n"))).alias("vs")).select("vs").distinct()
    pairs = F.flatten(F.transform("vs", lambda x, i: F.transform(F.slice("vs", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    alike = lambda p: F.least(p["x"]["n"], p["y"]["n"]) >= F.greatest(p["x"]["n"], p["y"]["n"]) * (threshold - 1e-9)
    pairs = lists.select(F.explode(F.filter(pairs, alike)).alias("p"))
    pairs = pairs.select(F.col("p.x.vertex").alias("a"), F.col("p.y.vertex").alias("b")).distinct()
    pairs = pairs.join(inside("a", "ca"), "a", "left").join(inside("b", "cb"), "b", "left")
    pairs = pairs.where("ca is null or cb is null or ca <> cb").select("a", "b")  # the others are compared in their cluster
    side = lambda v, s: sets.select(F.col("vertex").alias(v), F.col("shingles").alias(s))
    pairs = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(both / (F.size("sa") + F.size("sb") - both) >= threshold).select("a", "b").distinct()


def _clusters(clusters: DataFrame, facts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """vertex, low, links of clusters of larger buckets, all against all in blocks: a set is copied once for each block of its cluster."""
    held = clusters.select("vertex", F.col("component").alias("cluster")).join(facts, "vertex")
    blocks = held.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    held = held.join(small_side(blocks, BROADCAST), "cluster").withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    dealt = held.join(sets, "vertex").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "vertex", "members", "block", "shingles", "bands")
    return dealt.groupBy("cluster", "i", "j").applyInArrow(_compare(threshold), _BLOCK_OUT)


def _with_digests(docs: DataFrame, n: int, name: str) -> DataFrame:
    """docs with the digest of each row's text in a column of that name."""

    def run(batches):
        for part in slices(batches):
            yield part.append_column(name, pa.array([_digest(shingles(t, n)) for t in part.column("text").to_pylist()], pa.binary()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which one of each class stays, the one with the least (doc_id, digest), null ids last; columns as in docs.

    Texts without a word are classes of their own: they stay, those that stand repeatedly under one id once. Where a doc_id stands
    once it decides alone; rows whose id is null or stands repeatedly are told apart by their texts' digests.
    """
    gone_id, twice_id, digest, win_id, win = (free_name(docs, c) for c in ("gone_id", "twice_id", "own_digest", "winner_id", "winner"))
    found = join_documents(docs, **options)
    ids = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("rows"))
    ids = materialize(ids, "kept")
    gone = ids.where("class_id <> doc_id and rows = 1").select(F.col("doc_id").alias(gone_id))
    gone = small_side(materialize(gone, "gone"), 1_000_000)
    twice = small_side(materialize(ids.where("rows > 1").select(F.col("doc_id").alias(twice_id)), "twice"), 1_000_000)
    left = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    if ids.where("doc_id is null or rows > 1").limit(1).count() == 0:
        return left
    sure = left.where("doc_id is not null").join(twice, F.col("doc_id") == F.col(twice_id), "left_anti")
    unsure = left.where("doc_id is null").unionByName(left.join(twice, F.col("doc_id") == F.col(twice_id), "left_semi"))
    unsure = materialize(_with_digests(unsure, options.get("n", WORDS), digest), "unsure")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
    winners = found.where("digest is not null").groupBy("component").agg(least.alias("w"))
    winners = winners.select(F.col("w.doc_id").alias(win_id), F.col("w.digest").alias(win))
    winners = small_side(materialize(winners, "winners"), BROADCAST)
    once = unsure.where(F.col(digest).isNotNull()).dropDuplicates(["doc_id", digest])
    once = once.join(winners, (F.col(digest) == F.col(win)) & F.col("doc_id").eqNullSafe(F.col(win_id)), "left_semi")
    empty = unsure.where(F.col(digest).isNull())
    empty = empty.where("doc_id is null").unionByName(empty.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return sure.unionByName(once.unionByName(empty).drop(digest))
