"""Token ids in compressed files: a wavelet matrix per shard.

A file holds the ids of consecutive documents as bit-planes, the highest bit first, each plane ordered by the bits above it
(zeros before ones, stably). Planes are cut into blocks, compressed one by one, with the number of ones before each block;
so a token, the count of a token before a place and its k-th occurrence are found by reading one block for each plane.

Layout, little-endian: magic, then the lengths (uint64) of ids, bit-planes and documents, zeros per plane (int64), then three
compressed arrays with their byte length (uint64) before each: ids of the documents (int64), their null flags (uint8), their
token counts (int64); then for each plane the compressed sizes of its blocks (uint32) and the ones before each (int64); then
the blocks.
"""

from __future__ import annotations

import uuid
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_path, small_side
from ._common import id_and_text, slices, store_of
from ._units import WordEncoder

MAGIC = b"WMTK0001"
BLOCK = 1 << 16  # bits of a block; a multiple of 8
END_ID = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def build(ids: np.ndarray, doc_ids: list[int | None], counts: list[int]) -> bytes:
    """File of the ids (unsigned) of documents in order; counts are their numbers of ids."""
    n, levels = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
    pack = zstandard.ZstdCompressor(level=1).compress
    seq = np.ascontiguousarray(ids, np.uint16 if levels <= 16 else np.uint32)
    zeros, tables, blocks = [], [], []
    for level in range(levels):
        bit = (seq & seq.dtype.type(1 << (levels - 1 - level))) != 0
        plane = np.packbits(bit)
        own = [pack(plane[a : a + BLOCK // 8].tobytes()) for a in range(0, len(plane), BLOCK // 8)]
        ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        tables += [np.array([len(b) for b in own], "<u4").tobytes(), (ones.cumsum() - ones).astype("<i8").tobytes()]
        blocks += own
        seq = np.concatenate([np.compress(~bit, seq), np.compress(bit, seq)])
        zeros.append(n - int(ones.sum()))
    docs = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.array(counts, "<i8")]
    packed = [pack(a.tobytes()) for a in docs]
    head = MAGIC + np.array([n, levels, len(doc_ids)], "<u8").tobytes() + np.array(zeros, "<i8").tobytes()
    return head + b"".join(len(p).to_bytes(8, "little") + p for p in packed) + b"".join(tables) + b"".join(blocks)


class Shard:
    """Reader of one file's bytes; blocks are decompressed when they are needed, the last 256 of them kept."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.data = data
        self.n, self.levels, self.n_docs = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        self.zeros = np.frombuffer(data, "<i8", self.levels, 32).tolist()
        at = 32 + 8 * self.levels
        docs = []
        for kind in ("<i8", "u1", "<i8"):
            size = int.from_bytes(data[at : at + 8], "little")
            docs.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size]) if self.n_docs else b"", kind))
            at += 8 + size
        self.doc_ids = [None if z else d for d, z in zip(docs[0].tolist(), docs[1].tolist(), strict=True)]
        self.counts = docs[2]
        per = -(-self.n // BLOCK)
        self.ones, sizes = [], []
        for _ in range(self.levels):
            sizes.append(np.frombuffer(data, "<u4", per, at).astype(np.int64))
            self.ones.append(np.frombuffer(data, "<i8", per, at + 4 * per))
            at += 12 * per
        ends = at + np.concatenate(sizes).cumsum()
        self.starts = np.concatenate([[at], ends]).astype(np.int64)
        self.per = per
        self._block = lru_cache(256)(self._read)

    def _read(self, level: int, block: int) -> np.ndarray:
        k = level * self.per + block
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.starts[k] : self.starts[k + 1]])
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=min(BLOCK, self.n - block * BLOCK))

    def _rank(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, rest = divmod(i, BLOCK)
        if block == self.per:
            return self.n - self.zeros[level]
        return int(self.ones[level][block]) + int(self._block(level, block)[:rest].sum())

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.levels):
            bit = int(self._block(level, i // BLOCK)[i % BLOCK])
            token = token << 1 | bit
            ones = self._rank(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank(level, low), self._rank(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often a token occurs in places low to high."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of a token's k-th occurrence, from 0."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            want = i - self.zeros[level] if bit else i
            before = self.ones[level] if bit else np.arange(self.per) * BLOCK - self.ones[level]
            block = int(np.searchsorted(before, want, side="right")) - 1
            i = block * BLOCK + int(np.flatnonzero(self._block(level, block) == bit)[want - before[block]])
        return i

    def tokens(self) -> np.ndarray:
        """All tokens: planes are undone from the lowest bit up, each by one scatter."""
        seq = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = np.concatenate([self._read(level, b) for b in range(self.per)]).view(bool) if self.per else np.zeros(0, bool)
            out, zeros = np.empty_like(seq), self.zeros[level]
            out[np.flatnonzero(~bit)] = seq[:zeros]
            out[np.flatnonzero(bit)] = seq[zeros:] | seq.dtype.type(1 << (self.levels - 1 - level))
            seq = out
        return seq.astype(np.uint32)


@cache
def encoder(path: str) -> WordEncoder:
    """One for each worker process, so its cache lives from task to task."""
    return WordEncoder(path)


#: One row for each file.
FILES = T.StructType([T.StructField(n, T.StringType() if n == "file" else T.LongType()) for n in ("shard", "part", "n_docs", "n_tokens", "size", "file")])


def write_shards(docs: DataFrame, path: str | None = None, docs_per_shard: int = 4096, max_tokens: int = 4_000_000, max_ranges: int = 8192, directory: str | None = None) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order as files; returns the written table FILES, one row for each file.

    Null ids come first; equal ids are ordered by the hash of their texts and by the texts. Each document's ids are followed by
    END_ID; a null text has only that. Tasks take ranges of (doc_id, hash), at most max_ranges of them; a task begins a new file
    (part) where the next document would pass max_tokens or docs_per_shard, so it holds no more than that and one document.

    Files stand in directory (a URI that pyarrow can write; by default a folder in the shared one) as shard-NNNNN-NNNNN.wm. A file is
    written under a task's own name first and then renamed, so a task that is repeated leaves the same whole files.
    """
    path = path or default_vocabulary()
    directory = directory or scratch_path(docs.sparkSession, "tokens")
    source = id_and_text(docs)
    ranges = min(max_ranges, max(1, -(-source.count() // docs_per_shard)))
    keys = ("doc_id", F.xxhash64("text"))
    ordered = source.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys, "text")

    def run(batches):
        from pyspark import TaskContext

        shard, part, enc = TaskContext.get().partitionId(), 0, encoder(path)
        store, root = store_of(directory)
        store.create_dir(root, recursive=True)
        held, ids, counts, total = [], [], [], 0

        def flush():
            name = f"shard-{shard:05d}-{part:05d}.wm"
            content = build(np.concatenate(held), ids, counts)
            with store.open_output_stream(own := f"{root}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(content)
            store.move(own, f"{root}/{name}")
            row = (shard, part, len(ids), total, len(content), f"{directory}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], FILES.names)

        end = np.array([END_ID], np.uint32)
        for batch in slices(batches, 512):
            flat, lengths = enc.texts([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, own, n in zip(batch.column("doc_id").to_pylist(), np.split(flat, lengths.cumsum()[:-1]), (lengths + 1).tolist(), strict=True):
                if held and (total + n > max_tokens or len(ids) == docs_per_shard):
                    yield flush()
                    held, ids, counts, total, part = [], [], [], 0, part + 1
                held += (own, end)
                ids.append(doc_id)
                counts.append(n)
                total += n
        if held:
            yield flush()

    return materialize(ordered.mapInArrow(run, FILES), "shards")


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files of the table FILES."""

    def run(batches):
        for batch in slices(batches, 1):
            for shard, part, file in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "file")), strict=True):
                s = open_shard(file)
                raw, ends = s.tokens().astype("<u4"), s.counts.cumsum()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - s.counts).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([shard] * s.n_docs), pa.array([part] * s.n_docs), pa.array(s.doc_ids, pa.int64()), pa.array(ends - s.counts), pa.array(s.counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "doc_id", "own", "n_tokens", "ids_crc32"])

    tasks = max(1, min(8192, files.count()))
    rows = files.select("shard", "part", "file").repartition(tasks, "shard", "part").mapInArrow(run, "shard long, part long, doc_id long, own long, n_tokens long, ids_crc32 long")
    # prefix sums over shards (write_shards bounds their number), then over each shard's own parts
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.select("shard", "part", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("before"))
    before = parts.join(shards, "shard").select("shard", "part", (F.col("base") + F.col("before")).alias("before"))
    return rows.join(small_side(before, 100_000), ["shard", "part"]).select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def open_shard(file: str) -> Shard:
    """The file at a URI or path."""
    store, name = store_of(file)
    with store.open_input_file(name) as f:
        return Shard(f.read())
