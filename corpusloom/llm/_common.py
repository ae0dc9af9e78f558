"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of text that one vectorised step takes: beside its batch, a task holds one such slice, or one row that is longer.
SLICE_ROWS, SLICE_BYTES = 128, 4 << 20


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows, and of so many bytes in each string or binary column unless one row alone has more."""
    for batch in batches:
        wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        lengths = [np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64) for c in wide]
        held = np.max(lengths, axis=0).cumsum() if lengths else np.zeros(batch.num_rows, np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(held[at - 1]) if at else 0
            stop = min(at + rows, max(at + 1, int(np.searchsorted(held, before + size, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop
    _give_back()


def _give_back() -> None:
    """Return memory that freed arrays left to the allocators, as an idle worker would keep it from its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns most operators read; all others, whatever their names, are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def store_of(uri: str):
    """pyarrow's file system of a URI or path, and the path in it."""
    from pyarrow import fs

    if re.match(r"(file:)?/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))
