"""A ragged store: arrays of different lengths in buffer files with an index of offsets, appended by tasks and read by byte ranges.

    rows.write.format("ragged").mode("append").save(path)      # rows: uid, values
    spark.read.format("ragged").load(path)                     # all rows, or those whose uid a filter names
    slices(spark, path, wanted)                                # single slices, or parts of slices, by their byte ranges

Each task writes one buffer (values one after the other, no padding) and one index (part, uid, start, length) in Parquet. What a
task wrote counts once the job commits: the driver then writes the next version of the list of parts, so tasks that are run
twice or fail leave nothing that readers see. A version is written whole or not at all; of two jobs that append at once the later one
fails when it finds its version taken.

Values are numbers, or arrays of numbers that all have one width. The option dtype sets how they are stored (float16 is read as
float). Null arrays are stored as empty ones; null numbers are NaN in floating stores and an error in whole ones.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .files import put, store_of

#: Spark's name of a number's type -> the type that it is stored as, and the other way round.
STORED = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}
SPARK = {v: k for k, v in STORED.items()} | {"float16": "float"}
#: Bytes that a reader holds at once, unless one row has more, and values of one partition of a whole read.
CHUNK_BYTES, PARTITION_VALUES = 16 << 20, 32 << 20


def _versions(path: str) -> list[int]:
    store, root = store_of(path)
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(f"{root}/_versions", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))


def describe(path: str) -> dict:
    """The last version: dtype, width (None for plain numbers), uid (its type) and parts (name, rows, values, least, most)."""
    versions = _versions(path)
    if not versions:
        raise FileNotFoundError(f"no ragged store in {path}")
    store, root = store_of(path)
    with store.open_input_stream(f"{root}/_versions/{versions[-1]:08d}.json") as f:
        return json.loads(f.read())


def encode(values: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray, int | None]:
    """The numbers of a list column in a row, the length of each list, and the width of inner lists (None: plain numbers; 0: none seen)."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(values), 0), np.int64)
    flat, width = values.flatten(), None
    if pa.types.is_list(flat.type):
        widths = np.unique(np.asarray(pc.fill_null(pc.list_value_length(flat), -1)))
        if len(widths) > 1 or (len(widths) and widths[0] < 1):
            raise ValueError(f"inner arrays must have one width: {widths[:5].tolist()}")
        flat, width = flat.flatten(), int(widths[0]) if len(widths) else 0
    if flat.null_count and not dtype.startswith("float"):
        raise ValueError(f"a null can't be stored as {dtype}")
    numbers = flat.to_numpy(zero_copy_only=False)
    if not dtype.startswith("float") and len(numbers) and (numbers.max() > np.iinfo(dtype).max or numbers.min() < np.iinfo(dtype).min):
        raise ValueError(f"a value is beyond the range of {dtype}")
    return numbers.astype(dtype), lengths, width


def decode(raw: np.ndarray, lengths: np.ndarray, dtype: str, width: int | None, kind: pa.DataType) -> pa.Array:
    """The list column of consecutive rows whose numbers are raw."""
    flat = pa.array(raw.astype("float32") if dtype == "float16" else raw)
    if width is not None:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(raw) + 1, max(1, width), dtype=np.int32)), flat)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lengths.cumsum()]).astype(np.int32)), flat).cast(kind)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    values: int
    width: int | None
    least: object
    most: object


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, uid: str, dtype: str, overwrite: bool):
        self.path, self.uid, self.dtype, self.overwrite = path, uid, dtype, overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = store_of(self.path)
        store.create_dir(root)
        name, index = f"{self.job}-{uuid.uuid4().hex}", []
        rows = values = 0
        width: int | None = None
        with store.open_output_stream(f"{root}/{name}.bin") as out:
            for batch in iterator:
                numbers, lengths, own = encode(batch.column(1), self.dtype)
                if own and width and own != width:
                    raise ValueError(f"inner arrays must have one width: {own}, {width}")
                width = own or width
                starts = values + np.concatenate([[0], lengths.cumsum()])
                index.append(pa.table({"uid": batch.column(0), "start": starts[:-1], "length": lengths}))
                rows, values = rows + batch.num_rows, int(starts[-1])
                out.write(np.ascontiguousarray(numbers).tobytes())
        if not rows:
            store.delete_file(f"{root}/{name}.bin")
            return Part("", 0, 0, None, None, None)
        table = pa.concat_tables(index)
        table = table.add_column(0, "part", pa.array([name] * rows, pa.string()))
        with store.open_output_stream(f"{root}/{name}.parquet") as out:
            pq.write_table(table, out, row_group_size=65536)
        ends = pc.min_max(table["uid"]).as_py()
        return Part(name, rows, values, width, ends["min"], ends["max"])

    def commit(self, messages: list[Part | None]) -> None:
        """Write the next version; if this raises, Spark calls abort()."""
        store, root = store_of(self.path)
        new = [m for m in messages if m and m.rows]
        versions = _versions(self.path)
        last = describe(self.path) if versions else None
        old = last["parts"] if last and not self.overwrite else []
        held = [m.width for m in new] + ([last["width"]] if old else [])
        widths = {w for w in held if w}
        if len(widths) > 1 or len({w is None for w in held}) > 1 or (old and (last["dtype"], last["uid"]) != (self.dtype, self.uid)):
            raise ValueError(f"the store holds {last and (last['dtype'], last['width'], last['uid'])}, not {self.dtype}, {sorted(widths)}, {self.uid}")
        parts = old + [{"name": m.name, "rows": m.rows, "values": m.values, "least": m.least, "most": m.most} for m in new]
        width = next(iter(widths), 0 if 0 in held else None)
        number = versions[-1] + 1 if versions else 0
        store.create_dir(f"{root}/_versions")
        target = f"{root}/_versions/{number:08d}.json"
        if number in _versions(self.path):
            raise RuntimeError(f"version {number} of {self.path} was written meanwhile")
        put(store, target, json.dumps({"dtype": self.dtype, "width": width, "uid": self.uid, "parts": parts}).encode())
        if self.overwrite and last:
            self._drop([p["name"] for p in last["parts"]])

    def abort(self, messages: list[Part | None]) -> None:
        self._drop([m.name for m in messages if m and m.rows])

    def _drop(self, names: list[str]) -> None:
        store, root = store_of(self.path)
        for name in names:
            for ending in ("bin", "parquet"):
                with contextlib.suppress(FileNotFoundError):
                    store.delete_file(f"{root}/{name}.{ending}")


@dataclass
class Stretch(InputPartition):
    part: str
    first: int
    rows: int


class Reader(DataSourceReader):
    """A partition for each stretch of a part; a filter that names uids leaves out the parts and rows that can't hold them."""

    def __init__(self, path: str, kind: pa.DataType):
        self.path, self.kind = path, kind
        self.about = describe(path)
        self.wanted: set | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("uid",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            yield f  # Spark tests the rows once more

    def partitions(self) -> list[Stretch]:
        out = []
        for p in self.about["parts"]:
            if self.wanted is not None and not any(w is not None and p["least"] is not None and p["least"] <= w <= p["most"] for w in self.wanted):
                continue
            step = max(1, p["rows"] * PARTITION_VALUES // max(PARTITION_VALUES, p["values"] * (self.about["width"] or 1)))
            out += [Stretch(p["name"], a, min(step, p["rows"] - a)) for a in range(0, p["rows"], step)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, root = store_of(self.path)
        index = pq.read_table(f"{root}/{partition.part}.parquet", columns=["part", "uid", "start", "length"], filesystem=store).slice(partition.first, partition.rows)
        if self.wanted is not None:
            index = index.filter(pc.is_in(index["uid"], pa.array(list(self.wanted), index["uid"].type)))
        for batch in index.to_batches():
            yield from read_ranges([batch], self.path, self.about, self.kind, ["uid"])


class RaggedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ragged"

    def schema(self) -> str:
        about = describe(self.options["path"])
        inner = SPARK[about["dtype"]]
        return f"uid {about['uid']}, values array<{inner if about['width'] is None else f'array<{inner}>'}>"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], _list_type(describe(self.options["path"])))

    def writer(self, schema, overwrite: bool) -> Writer:
        if schema.names != ["uid", "values"]:
            raise ValueError(f"columns must be uid, values: {schema.names}")
        inner = schema["values"].dataType.elementType
        inner = getattr(inner, "elementType", inner)
        dtype = self.options.get("dtype", STORED.get(inner.simpleString(), ""))
        if dtype not in SPARK:
            raise ValueError(f"can't store {inner.simpleString()} as {dtype!r}")
        return Writer(self.options["path"], schema["uid"].dataType.simpleString(), dtype, overwrite)


def _list_type(about: dict) -> pa.DataType:
    inner = pa.float32() if about["dtype"] == "float16" else pa.from_numpy_dtype(np.dtype(about["dtype"]))
    return pa.list_(pa.list_(inner)) if about["width"] is not None else pa.list_(inner)


def read_ranges(batches, path: str, about: dict, kind: pa.DataType, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Of index rows (part, start, length, and columns to keep) the keep columns and values. Only the rows' own bytes are read; neighbours in one read."""
    store, root = store_of(path)
    size = np.dtype(about["dtype"]).itemsize * (about["width"] or 1)
    opened: dict[str, object] = {}
    for batch in batches:
        names, starts, lengths = (batch.column(c) for c in ("part", "start", "length"))
        names, starts, lengths = names.to_pylist(), starts.to_numpy(), lengths.to_numpy()
        a = 0
        while a < len(names):
            b, held = a + 1, int(lengths[a]) * size
            while b < len(names) and names[b] == names[a] and starts[b] == starts[b - 1] + lengths[b - 1] and held + int(lengths[b]) * size <= CHUNK_BYTES:
                held += int(lengths[b]) * size
                b += 1
            if names[a] not in opened:
                for f in opened.values():
                    f.close()
                opened = {names[a]: store.open_input_file(f"{root}/{names[a]}.bin")}
            raw = opened[names[a]].read_at(held, int(starts[a]) * size) if held else b""
            if len(raw) != held:
                raise EOFError(f"{names[a]}.bin ends before value {int(starts[b - 1] + lengths[b - 1])}")
            values = decode(np.frombuffer(raw, about["dtype"]), lengths[a:b], about["dtype"], about["width"], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), values], [*keep, "values"])
            a = b
    for f in opened.values():
        f.close()


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.dataSource.register(RaggedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(rows: DataFrame, path: str, mode: str = "append", dtype: str | None = None) -> None:
    """Append rows (uid, values) to a store, or put them in its place."""
    register(rows.sparkSession)
    out = rows.select("uid", "values").write.format("ragged").mode(mode)
    (out.option("dtype", dtype) if dtype else out).save(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """part, uid, start, length of every row of the last version."""
    about = describe(path)
    store, root = store_of(path)
    kinds = f"part string, uid {about['uid']}, start long, length long"
    base = path.rstrip("/")
    files = [f"{base}/{p['name']}.parquet" for p in about["parts"]]
    return spark.read.schema(kinds).parquet(*files) if files else spark.createDataFrame([], kinds)


def slices(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """uid, values for each row of wanted (uid, and if it has them first and count): the values of that row, or count of them from first on.

    The index is joined by uid, and each slice is read by its byte range, in the order of the buffers. Ranges are cut at the
    slice's end; uids that the store doesn't hold give no row, and one that it holds twice gives two.
    """
    about = describe(path)
    part = {"first", "count"} <= set(wanted.columns)
    asked = wanted.select(F.col("uid"), *([F.col("first").cast("long").alias("first"), F.col("count").cast("long").alias("n")] if part else []))
    rows = index(spark, path).join(asked, "uid")
    if part:
        first = F.least(F.greatest(F.col("first"), F.lit(0)), F.col("length"))
        n = F.least(F.greatest(F.col("n"), F.lit(0)), F.col("length") - first)
        rows = rows.select("part", "uid", (F.col("start") + first).alias("start"), n.alias("length"))
    inner = SPARK[about["dtype"]]
    out = f"uid {about['uid']}, values array<{inner if about['width'] is None else f'array<{inner}>'}>"
    kind = _list_type(about)
    rows = rows.select("part", "uid", "start", "length").sortWithinPartitions("part", "start")
    return rows.mapInArrow(lambda batches: read_ranges(batches, path, about, kind, ["uid"]), out)
