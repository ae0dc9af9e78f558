"""A lexicon that is kept up to date: a mergeable state of the reading miner, to which batches of documents are added in any order.

The state is a set of partial tables that add up: for each (word, pattern) its count, the first place it stands at and the form
found there; for each (word, pattern, context) its count, all three as hashes of 64 bits, as dealt_shapes() has them. Adding a batch writes its
partial tables and then a new list of the tables that count; a batch that is added again under its name replaces itself, so a streaming batch that
runs twice counts once. Contexts are dealt to parts by the first bits of a hash when they are added, so neither compaction nor lexicon moves them:
a task reads its part of every table. Numbers of parts are powers of two, so a part of a larger table lies in one of a smaller. Within a part
rows stand by word and pattern, which Parquet keeps once, so a row takes little more than the 8 bytes of its context.
Compaction merges all tables into one. Words with more raw patterns than the gates allow can't come back, as patterns only grow,
so their contexts are dropped then; that holds for the gates compacted with and for stricter ones.

lexicon() equals mine() over all documents added, however they were dealt into batches.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import materialize, small_side
from ..sources.files import put, store_of
from . import readings as R

#: Rows of contexts of one part.
ROWS_PER_PART = 2_000_000
CONTEXTS = "word long, pattern long, context long, n long"


def _parts(size: int) -> int:
    """The power of two at or above the parts that so many rows need, 8 or more."""
    return max(8, 1 << (-(-size // ROWS_PER_PART) - 1).bit_length()) if size else 8


def _files(uri: str) -> Iterator[pq.ParquetFile]:
    """The Parquet files of a folder, if there is one."""
    from pyarrow import fs

    store, root = store_of(uri)
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.base_name.endswith(".parquet"):
            with store.open_input_file(f.path) as file:
                yield pq.ParquetFile(file)


def _rows_of(tables: dict[str, int], part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """word, context, pattern, n of one of so many parts from all tables (path, number of its parts, at most as many)."""
    for path, own in tables.items():
        for file in _files(f"{path}/part={part * own // parts}"):
            for b in file.iter_batches(1 << 18, columns=["word", "context", "pattern", "n"]):
                if own < parts:
                    number = R._mixed(b["word"].to_numpy(), b["context"].to_numpy())
                    b = b.filter(pa.array(R._part_of(number, parts) == part))
                yield b


class ReadingState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        from pyarrow import fs

        store, root = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/lists", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def tables(self) -> dict[str, str]:
        """Name of each batch that counts -> its folder; what was compacted stands under one of the merged batches' names each."""
        numbers = self._numbers()
        if not numbers:
            return {}
        store, root = store_of(self.path)
        with store.open_input_stream(f"{root}/lists/{numbers[-1]:08d}.json") as f:
            return json.loads(f.read())

    def _publish(self, tables: dict[str, str]) -> None:
        store, root = store_of(self.path)
        numbers = self._numbers()
        store.create_dir(f"{root}/lists")
        put(store, f"{root}/lists/{(numbers[-1] + 1 if numbers else 0):08d}.json", json.dumps(tables).encode())

    def _drop(self, folders: set[str]) -> None:
        store, root = store_of(self.path)
        for name in folders:
            store.delete_dir(f"{root}/{name}")

    def add(self, occ: DataFrame | R.Texts, name: str) -> None:
        """Add the occurrences of a batch. A name that was compacted can't be added again."""
        before = self.tables()
        if before.get(name, "").startswith("merged-"):
            raise ValueError(f"batch {name} is merged already")
        folder = f"batch-{re.sub('[^A-Za-z0-9]', '-', name)}-{uuid.uuid4().hex[:8]}"
        parts = _parts(self._write_patterns(R.pattern_counts(occ), folder))
        self._write_contexts(R.dealt_counts(occ, parts), folder, parts)
        self._publish(before | {name: folder})
        if name in before:
            self._drop({before[name]})

    def _write_patterns(self, rows: DataFrame, folder: str) -> int:
        """The number of occurrences."""
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{folder}/patterns")
        return self.spark.read.parquet(f"{self.path}/{folder}/patterns").agg(F.sum("n")).first()[0] or 0

    def _write_contexts(self, rows: DataFrame, folder: str, parts: int) -> None:
        rows.write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/{folder}/contexts-{parts}")

    def patterns(self) -> DataFrame:
        """word, pattern, n, first, example over all batches; rows lie by word."""
        rows = self._read_patterns().repartition("word").groupBy("word", "pattern").agg(F.sum("n").alias("n"), F.min(F.struct("first", "example")).alias("f"))
        return rows.select("word", "pattern", "n", "f.first", "f.example")

    def contexts(self) -> DataFrame:
        """word, left, right, pattern, n over all batches, by words and patterns as written, to look at; left is the hash of both neighbours, right 0.

        Rows are shuffled once, by context, if the names are few enough to be broadcast. The state itself works by hashes.
        """
        rows = self.spark.read.schema(CONTEXTS).option("recursiveFileLookup", "true").parquet(*self._dealt())
        rows = rows.select(F.col("word").alias("w"), F.col("pattern").alias("p"), F.col("context").alias("left"), "n")
        names = self.patterns().select("word", "pattern", F.xxhash64("word").alias("w"), F.xxhash64("pattern").alias("p"))
        named = rows.join(small_side(materialize(names, "names"), R.WORDS), ["w", "p"]).select("word", "left", F.lit(0).alias("right"), "pattern", "n")
        return named.repartition("word", "left").groupBy("word", "left", "right", "pattern").agg(F.sum("n").alias("n"))

    def _folders(self) -> list[str]:
        folders = sorted(set(self.tables().values()))
        if not folders:
            raise ValueError(f"no batch was added to {self.path}")
        return folders

    def _read_patterns(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}/patterns" for f in self._folders()])

    def _dealt(self) -> dict[str, int]:
        """The tables of contexts and how many parts they have."""
        from pyarrow import fs

        store, root = store_of(self.path)
        found = {}
        for folder in self._folders():
            names = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/{folder}")) if re.fullmatch(r"contexts-\d+", f.base_name)]
            if len(names) != 1:
                raise ValueError(f"{folder} was written in another form: add its documents again")
            found[f"{self.path}/{folder}/{names[0]}"] = int(names[0].split("-")[1])
        return found

    def _by_part(self, parts: int, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """made() of all rows of each part, a task for each; nothing is shuffled."""
        tables = self._dealt()

        def run(batches):
            for b in batches:
                for part in b["id"].to_pylist():
                    yield from made(_rows_of(tables, part, parts))

        return self.spark.range(0, parts, 1, parts).mapInArrow(run, schema)

    def _parts_for(self, size: int) -> int:
        return max(_parts(size), *self._dealt().values())

    def compact(self, gates: R.Gates = R.Gates()) -> None:
        """Merge all tables into one, without contexts that no lexicon of these gates needs any more."""
        before = self.tables()
        folder = f"merged-{uuid.uuid4().hex[:8]}"
        parts = self._parts_for(self._write_patterns(self.patterns(), folder))
        raw = self.spark.read.parquet(f"{self.path}/{folder}/patterns").groupBy("word").agg(F.count("*").alias("raw"))
        lost = f"{self.path}/{folder}/lost"
        raw.where(F.col("raw") > gates.max_raw_patterns).select(F.xxhash64("word").alias("word")).write.parquet(lost)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = [f.read()["word"].to_numpy() for f in _files(lost)]  # 8 bytes a word
            return R.counts_of(batches, parts, np.concatenate(words) if words else None)

        self._write_contexts(self._by_part(parts, rows, f"part int, {CONTEXTS}"), folder, parts)
        self._publish(dict.fromkeys(before, folder))
        self._drop(set(before.values()))

    def lexicon(self, gates: R.Gates = R.Gates()) -> DataFrame:
        """What mine() returns for the occurrences of all batches together."""
        kept = materialize(R.gated(self.patterns(), gates, "example"), "readings")
        parts = self._parts_for(self._read_patterns().agg(F.sum("n")).first()[0] or 0)
        shapes = self._by_part(parts, R.shapes_of, f"word long, shape {R._shape()}, contexts long")
        return R.agreeing(kept, R.shapes_agreement(shapes), gates)


def maintain(documents: DataFrame, occurrences_of, state: ReadingState, checkpoint: str) -> StreamingQuery:
    """Add each micro-batch of a stream of documents to the state; occurrences_of makes occurrences of a batch."""

    def step(batch: DataFrame, number: int) -> None:
        state.add(occurrences_of(batch), f"stream-{number}")

    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
