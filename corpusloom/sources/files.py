"""Files that tasks read and write by byte ranges, on any file system that pyarrow reaches (local or mounted, hdfs, s3, gs)."""

from __future__ import annotations

import re

from pyarrow import fs


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    if re.match(r"(file:)?/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri).rstrip("/")
    store, path = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))
    return store, path.rstrip("/")


def put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a whole file so that readers see all of it or none."""
    with store.open_output_stream(path + ".tmp") as out:
        out.write(data)
    store.move(path + ".tmp", path)
