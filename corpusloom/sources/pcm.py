"""Recordings as RIFF/WAVE files: headers read alone, samples only where asked for, and files written by tasks.

    spark.read.format("pcm").load(folder)                                    # path, size, rate, channels, bits, frames, seconds, error
    spark.read.format("pcm").option("samples", 16000).load(folder)           # and samples: one channel at 16 kHz

A header costs a few short reads however long its recording is, so a folder is probed at the price of its number of files. A file
that can't be read is a row with an error and no numbers; it stops nothing.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .files import put, store_of

#: Fixed values of the format: codes of whole and floating samples, and the code that says to look further on.
WHOLE, FLOATING, EXTENSIBLE = 1, 3, 0xFFFE
#: Files of one partition when only headers are read, and bytes of one when samples are.
FILES, BYTES = 2000, 64 << 20

COLUMNS = [("path", "string"), ("size", "long"), ("rate", "int"), ("channels", "int"), ("bits", "int"), ("frames", "long"), ("seconds", "double"), ("error", "string")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


@dataclass
class Header:
    rate: int
    channels: int
    bits: int
    code: int
    data_at: int
    frames: int


def header(f, size: int) -> Header:
    """Walk the chunks of an open file. Of a data chunk that says to be longer than the file (or gives no length) what is there counts."""
    f.seek(0)
    start = f.read(12)
    if len(start) < 12 or start[:4] != b"RIFF" or start[8:] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, about = 12, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            body = f.read(min(length, 40))
            if len(body) < 16:
                raise ValueError("the format chunk is cut off")
            code, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
            if code == EXTENSIBLE and len(body) >= 26:
                code = struct.unpack("<H", body[24:26])[0]
            if code not in (WHOLE, FLOATING) or not channels or not rate or bits not in ((8, 16, 24, 32) if code == WHOLE else (32, 64)):
                raise ValueError(f"samples of format {code} with {bits} bits aren't supported")
            about = (rate, channels, bits, code)
        elif name == b"data":
            if about is None:
                raise ValueError("data before the format")
            held = min(length, size - at - 8)
            return Header(*about, at + 8, held // (about[1] * about[2] // 8))
        at += 8 + length + length % 2
    raise ValueError("no data chunk")


def decode(raw: bytes, h: Header) -> np.ndarray:
    """Samples from -1 to 1, mean of the channels."""
    if h.code == FLOATING:
        x = np.frombuffer(raw, f"<f{h.bits // 8}").astype(np.float64)
    elif h.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    elif h.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    else:
        x = np.frombuffer(raw, f"<i{h.bits // 8}") / float(1 << (h.bits - 1))
    return x.reshape(-1, h.channels).mean(1)


def resample(x: np.ndarray, rate: int, to: int, lobes: int = 12) -> np.ndarray:
    """x at another rate: a windowed sinc below the lower of both Nyquist frequencies, with one set of weights for each phase."""
    if rate == to or not len(x):
        return x
    common = math.gcd(rate, to)
    up, down = to // common, rate // common
    cut = 0.97 * min(1.0, up / down)  # in cycles of the input's Nyquist frequency
    reach = math.ceil(lobes / cut)
    padded = np.pad(x, reach)
    out = np.empty(-(-len(x) * up // down))
    taps = np.arange(-reach + 1, reach + 1)
    for phase in range(min(up, len(out))):
        n = np.arange(phase, len(out), up)
        whole, part = n[0] * down // up, (n[0] * down % up) / up
        away = taps - part
        weight = cut * np.sinc(cut * away) * np.where(np.abs(away) < reach, 0.5 + 0.5 * np.cos(np.pi * away / reach), 0)
        first = whole + reach + taps[0] + np.arange(len(n)) * down
        y = np.zeros(len(n))
        for k, w in enumerate(weight):
            y += w * padded[np.minimum(first + k, len(padded) - 1)]
        out[n] = y
    return out


def encode(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A file of 16-bit samples; values beyond -1 to 1 are cut. samples: frames, or frames x channels one after the other."""
    data = np.clip(np.round(np.asarray(samples, np.float64) * 32767), -32768, 32767).astype("<i2").tobytes()
    about = struct.pack("<4sIHHIIHH", b"fmt ", 16, WHOLE, channels, rate, rate * channels * 2, channels * 2, 16)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(about) + 8 + len(data), b"WAVE") + about + struct.pack("<4sI", b"data", len(data)) + data


def probe(store: fs.FileSystem, name: str, path: str, rate: int = 0) -> tuple:
    """The columns' values of one file, and with a rate its samples at that rate."""
    try:
        with store.open_input_file(path) as f:
            size = f.size()
            h = header(f, size)
            samples = None
            if rate:
                f.seek(h.data_at)
                samples = resample(decode(f.read(h.frames * h.channels * h.bits // 8), h), h.rate, rate).astype(np.float32)
        return name, size, h.rate, h.channels, h.bits, h.frames, h.frames / h.rate, None, samples
    except (OSError, ValueError) as e:
        return name, None, None, None, None, None, None, str(e) or type(e).__name__, None


def _batch(rows: list[tuple], samples: bool) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(COLUMNS)]
    if samples:
        columns.append(pa.array([r[-1] for r in rows], pa.list_(pa.float32())))
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in COLUMNS] + ["samples"] * samples)


@dataclass
class Files(InputPartition):
    paths: list[str]


class PcmReader(DataSourceReader):
    def __init__(self, path: str, rate: int, ending: str):
        self.path, self.rate, self.ending = path, rate, ending

    def partitions(self) -> list[Files]:
        """Files of like number, or of like bytes if samples are read; the folder is listed once."""
        store, root = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.ending))
        out, held = [Files([])], 0
        for path, size in files:
            cost = size / BYTES if self.rate else 1 / FILES
            if out[-1].paths and held + cost > 1:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += cost
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        step = 16 if self.rate else 1000
        for a in range(0, len(partition.paths), step):
            yield _batch([probe(store, p, p, self.rate) for p in partition.paths[a : a + step]], bool(self.rate))


class PcmSource(DataSource):
    """Options: samples (a rate in Hz; without it headers alone are read), ending (of the files' names)."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return ", ".join(f"{n} {k}" for n, k in COLUMNS) + (", samples array<float>" if int(self.options.get("samples", 0)) else "")

    def reader(self, schema) -> PcmReader:
        return PcmReader(self.options["path"], int(self.options.get("samples", 0)), self.options.get("ending", ".wav"))


def read(spark: SparkSession, path: str, rate: int = 0) -> DataFrame:
    """The recordings below a folder, or one file; with a rate their samples too."""
    spark.dataSource.register(PcmSource)
    out = spark.read.format("pcm")
    return (out.option("samples", rate) if rate else out).load(path)


def probed(rows: DataFrame, path: str, root: str = "") -> DataFrame:
    """rows with seconds and error of the recording that each path names (below root, unless it is whole); one header is read for each row."""
    own = [c for c in rows.columns if c not in ("seconds", "error")]

    def run(batches):
        for b in batches:
            found = []
            for name in b.column(path).to_pylist():
                if name is None:
                    found.append((None, "no path"))
                    continue
                store, at = store_of(name if "://" in name or name.startswith("/") else f"{root}/{name}")
                got = probe(store, name, at)
                found.append((got[6], got[7]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.string())], [*own, "seconds", "error"])

    out = rows.select(*own)
    return out.mapInArrow(run, StructType([*out.schema, StructField("seconds", DoubleType()), StructField("error", StringType())]))


def fill_durations(manifest: DataFrame, root: str) -> DataFrame:
    """The manifest with durations that are missing or not above 0 taken from the recordings' headers; they stay 0 where none can be read."""
    known = manifest.where("coalesce(duration, 0) > 0")
    asked = probed(manifest.where("not coalesce(duration, 0) > 0"), "audio_path", root)
    filled = asked.withColumn("duration", F.coalesce("seconds", F.lit(0.0))).select(manifest.columns)
    return known.unionByName(filled)


def located(manifest: DataFrame, root: str) -> DataFrame:
    """The manifest with missing (whether no file stands at audio_path), and durations not above 0 taken from headers; one pass over its rows.

    Rows of a batch are looked up together; headers are read only where a duration is wanted.
    """
    own = [c for c in manifest.columns if c not in ("missing", "duration")]

    def run(batches):
        for b in batches:
            paths = b.column("audio_path").to_pylist()
            missing, seconds = [True] * len(paths), [x or 0.0 for x in b.column("duration").to_pylist()]
            groups: dict[str, list[tuple[int, str]]] = {}
            for i, name in enumerate(paths):
                if name:
                    whole = name if "://" in name or name.startswith("/") else f"{root}/{name}"
                    groups.setdefault(whole.partition("://")[0] if "://" in whole else "", []).append((i, whole))
            for named in groups.values():
                found = [store_of(whole) for _, whole in named]
                store = found[0][0]
                for (i, _), (_, at), info in zip(named, found, store.get_file_info([at for _, at in found]), strict=True):
                    missing[i] = info.type != fs.FileType.File
                    if not missing[i] and not seconds[i] > 0:
                        seconds[i] = probe(store, at, at)[6] or 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(missing), pa.array(seconds, pa.float64())], [*own, "missing", "duration"])

    rows = manifest.select(*own, F.col("duration").cast("double").alias("duration"))
    return rows.mapInArrow(run, StructType([*(f for f in rows.schema if f.name != "duration"), StructField("missing", BooleanType()), StructField("duration", DoubleType())]))


def write(rows: DataFrame, folder: str, rate: int) -> DataFrame:
    """uid, audio_path, duration of rows (uid, samples; optional channels): each is written as folder/uid.wav when the result is computed.

    A file is written whole and under one name, so a task that runs twice leaves the same file. uids must be fit for file names.
    """
    rows = rows.select(F.col("uid").cast("string").alias("uid"), "samples", (F.col("channels") if "channels" in rows.columns else F.lit(1)).cast("int").alias("channels"))

    def run(batches):
        store, root = store_of(folder)
        store.create_dir(root)
        for b in batches:
            paths, seconds = [], []
            for uid, samples, channels in zip(b.column("uid").to_pylist(), b.column("samples"), b.column("channels").to_pylist(), strict=True):
                values = samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.zeros(0)
                put(store, f"{root}/{uid}.wav", encode(values, rate, channels))
                paths.append(f"{root}/{uid}.wav")
                seconds.append(len(values) // channels / rate)
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(paths), pa.array(seconds, pa.float64())], ["uid", "audio_path", "duration"])

    return rows.mapInArrow(run, "uid string, audio_path string, duration double")


def write_corpus(rows: DataFrame, root: str, rate: int) -> None:
    """A corpus folder of rows (uid, text, split, samples; optional speaker): recordings, a JSON lines table for each split, and metadata.csv of all.

    What read_corpus() reads: a synthetic data set where the samples are made by Spark.
    """
    from ..session import materialize

    clips = materialize(write(rows, f"{root}/wavs", rate), "clips")
    speaker = F.col("speaker") if "speaker" in rows.columns else F.lit("default")
    table = rows.select(F.col("uid").cast("string").alias("uid"), "text", "split", speaker.alias("channel")).join(clips, "uid")
    table = materialize(table.select(F.col("uid").alias("id"), F.col("audio_path").alias("file_name"), "text", "duration", "split", "channel"), "corpus")
    for split in ("train", "dev", "test"):
        table.where(F.col("split") == split).drop("split").write.mode("overwrite").json(f"{root}/metadata/{split}.jsonl")
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{root}/metadata.csv")
