"""The ragged store and the recordings: round trips, ranges, appends, failed tasks, broken files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import pcm, ragged, readers

ROWS = [(i, [float(i * 10 + k) for k in range(i % 5)]) for i in range(40)]


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"uid long, values array<{kind}>")


def as_dict(df):
    return {r.uid: r["values"] for r in df.collect()}


def test_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "s")
    ragged.write(frame(spark, ROWS[:25]).repartition(3), path)
    ragged.write(frame(spark, ROWS[25:]), path)
    assert as_dict(spark.read.format("ragged").load(path)) == dict(ROWS)
    about = ragged.describe(path)
    assert (about["dtype"], about["width"], sum(p["rows"] for p in about["parts"])) == ("float64", None, 40)
    held = {p["name"]: p["values"] * 8 for p in about["parts"]}
    assert {n: (tmp_path / "s" / f"{n}.bin").stat().st_size for n in held} == held
    # offsets are the running sums of the lengths in each buffer
    for part in {r.part for r in ragged.index(spark, path).collect()}:
        rows = sorted((r.start, r.length) for r in ragged.index(spark, path).where(F.col("part") == part).collect())
        assert all(b[0] == a[0] + a[1] for a, b in zip(rows, rows[1:]))
    ragged.write(frame(spark, [(1, [5.0])]), path, "overwrite")
    assert as_dict(spark.read.format("ragged").load(path)) == {1: [5.0]}
    assert len(list((tmp_path / "s").glob("*.bin"))) == 1


def test_filters_reach_the_parts(spark, tmp_path):
    path = str(tmp_path / "s")
    for a in range(0, 40, 10):
        ragged.write(frame(spark, ROWS[a : a + 10]).coalesce(1), path)
    got = spark.read.format("ragged").load(path)
    assert as_dict(got.where("uid = 13")) == {13: ROWS[13][1]}
    assert as_dict(got.where("uid in (3, 39, 99)")) == {3: ROWS[3][1], 39: ROWS[39][1]}
    reader = ragged.Reader(path, ragged._list_type(ragged.describe(path)))
    list(reader.pushFilters([ragged.EqualTo(("uid",), 13)]))
    assert len(reader.partitions()) == 1


@pytest.mark.parametrize(("dtype", "kind"), [("int16", "smallint"), ("float16", "float"), ("float32", "float"), ("int8", "tinyint"), ("int64", "bigint")])
def test_ranges_of_wide_rows(spark, tmp_path, dtype, kind):
    path = str(tmp_path / "s")
    rows = [(f"u{i}", [[float(i + t), float(-t), 3.0] for t in range(i)]) for i in range(12)] + [("none", None)]
    df = spark.createDataFrame(rows, "uid string, values array<array<double>>").select("uid", F.col("values").cast(f"array<array<{kind}>>").alias("values"))
    ragged.write(df.repartition(2), path, dtype=dtype)
    asked = spark.createDataFrame([("u7", 2, 3), ("u7", 5, 99), ("u3", 9, 1), ("u4", -2, 2), ("zz", 0, 1)], "uid string, first long, count long")
    got = sorted((r.uid, [tuple(v) for v in r["values"]]) for r in ragged.slices(spark, path, asked).collect())
    assert got == [("u3", []), ("u4", [(4, 0, 3), (5, -1, 3)]), ("u7", [(9, -2, 3), (10, -3, 3), (11, -4, 3)]), ("u7", [(12, -5, 3), (13, -6, 3)])]
    whole = as_dict(ragged.slices(spark, path, df.select("uid")))
    assert whole["none"] == [] and whole["u5"] == [[5 + t, -t, 3] for t in range(5)] and len(whole) == 13


def test_slices_read_only_their_bytes(spark, tmp_path):
    path = str(tmp_path / "s")
    ragged.write(frame(spark, ROWS).coalesce(1), path)
    part = ragged.describe(path)["parts"][0]["name"]
    r = ragged.index(spark, path).where("uid = 14").first()
    raw = bytearray((tmp_path / "s" / f"{part}.bin").read_bytes())
    raw[: r.start * 8] = b"\xff" * (r.start * 8)
    (tmp_path / "s" / f"{part}.bin").write_bytes(raw[: (r.start + r.length) * 8])
    assert as_dict(ragged.slices(spark, path, frame(spark, ROWS[14:15]).select("uid"))) == {14: ROWS[14][1]}
    with pytest.raises(Exception, match="ends before"):
        ragged.slices(spark, path, frame(spark, ROWS[39:]).select("uid")).collect()


def test_refused_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    ragged.write(frame(spark, ROWS), path)
    before = sorted(p.name for p in (tmp_path / "s").iterdir())
    wide, named = spark.createDataFrame([(1, [[1.0, 2.0]])], "uid long, values array<array<double>>"), spark.createDataFrame([("a", [1.0])], "uid string, values array<double>")
    for bad, dtype, why in ((frame(spark, ROWS), "float32", "the store holds"), (wide, None, "the store holds"), (named, None, "the store holds")):
        with pytest.raises(Exception, match=why):
            ragged.write(bad, path, dtype=dtype)
        assert sorted(p.name for p in (tmp_path / "s").iterdir()) == before
    for bad, why in (([(1, [[1.0], [2.0, 3.0]])], "one width"), ([(1, [[1.0, 2.0]]), (2, [[1.0]])], "one width|the store holds")):
        with pytest.raises(Exception, match=why):
            ragged.write(spark.createDataFrame(bad, "uid long, values array<array<double>>"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="beyond the range"):
        ragged.write(frame(spark, [(1, [70000])], "int"), str(tmp_path / "u"), dtype="int16")
    with pytest.raises(Exception, match="null"):
        ragged.write(frame(spark, [(1, [None, 2])], "int"), str(tmp_path / "u"))
    with pytest.raises(Exception, match="no ragged store"):
        spark.read.format("ragged").load(str(tmp_path / "u")).count()


def test_a_part_that_no_version_names_is_not_read(spark, tmp_path):
    path = str(tmp_path / "s")
    ragged.write(frame(spark, ROWS[:5]).coalesce(1), path)
    name = ragged.describe(path)["parts"][0]["name"]
    for ending in ("bin", "parquet"):  # as a task leaves it that is run again
        (tmp_path / "s" / f"lost.{ending}").write_bytes((tmp_path / "s" / f"{name}.{ending}").read_bytes())
    assert as_dict(spark.read.format("ragged").load(path)) == dict(ROWS[:5])
    ragged.write(frame(spark, []), path)
    assert as_dict(spark.read.format("ragged").load(path)) == dict(ROWS[:5])


def wav(code, bits, rate, channels, data, extra=b"", size=None):
    body = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF\0\0\0\0WAVE" + extra + b"fmt " + struct.pack("<I", len(body)) + body + b"data" + struct.pack("<I", len(data) if size is None else size) + data


def test_formats_of_recordings(spark, tmp_path):
    x = np.array([0.5, -0.5, 0.25, 0.0])
    three = b"".join(struct.pack("<i", int(v * (1 << 23)))[:3] for v in x)
    files = {
        "a8": wav(1, 8, 100, 1, (x * 128 + 128).astype(np.uint8).tobytes()), "b16": wav(1, 16, 100, 2, np.repeat(x * 32768, 2).astype("<i2").tobytes()), "c24": wav(1, 24, 100, 1, three),
        "d32": wav(1, 32, 100, 1, (x * 2**31).astype("<i4").tobytes()), "e": wav(3, 32, 100, 1, x.astype("<f4").tobytes()), "f": wav(3, 64, 100, 1, x.astype("<f8").tobytes()),
        "g": wav(1, 16, 100, 1, (x * 32768).astype("<i2").tobytes(), extra=b"LIST\x03\0\0\0abc\0"), "h": wav(1, 16, 100, 1, (x * 32768).astype("<i2").tobytes(), size=0xFFFFFFFF),
    }
    for name, raw in files.items():
        (tmp_path / f"{name}.wav").write_bytes(raw)
    bad = {"x1": b"", "x2": b"RIFF\0\0\0\0WAVE", "x3": b"no sound at all" * 9, "x4": wav(7, 8, 100, 1, b"abcd"), "x5": wav(1, 16, 100, 0, b"")}
    for name, raw in bad.items():
        (tmp_path / f"{name}.wav").write_bytes(raw)
    (tmp_path / "notes.txt").write_text("no recording")
    rows = {r.path.rsplit("/", 1)[1][:-4]: r for r in pcm.read(spark, str(tmp_path)).collect()}
    assert sorted(rows) == sorted([*files, *bad])
    assert all((rows[n].frames, rows[n].seconds, rows[n].rate, rows[n].error) == (4, 0.04, 100, None) for n in files)
    assert rows["b16"].channels == 2 and all(rows[n].frames is None and rows[n].error for n in bad)
    for r in pcm.read(spark, str(tmp_path), 100).where("error is null").collect():
        assert np.allclose(r.samples, x, atol=0.01)


def test_resampling_keeps_a_tone():
    t = np.arange(8000) / 8000
    tone = np.sin(2 * np.pi * 440 * t)
    for to in (16000, 11025, 4000, 8000):
        got = pcm.resample(tone, 8000, to)
        want = np.sin(2 * np.pi * 440 * np.arange(len(got)) / to)
        assert len(got) == to and np.abs(got - want)[100:-100].max() < 0.01
    high = np.sin(2 * np.pi * 3000 * t)
    assert np.abs(pcm.resample(high, 8000, 4000))[100:-100].max() < 0.02  # above the new Nyquist frequency
    assert len(pcm.resample(np.zeros(0), 8000, 4000)) == 0


def test_corpus_of_recordings(spark, tmp_path):
    rows = spark.range(12).selectExpr("id as uid", "concat('text ', id) as text", "if(id < 8, 'train', if(id < 10, 'dev', 'test')) as split", "transform(sequence(1, 100 * cast(id + 1 as int)), i -> sin(i / 10d) / 2) as samples")
    pcm.write_corpus(rows, str(tmp_path), 1000)
    got = {r.uid: r for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and got["3"].split == "train" and got["11"].split == "test"
    assert all(abs(r.duration - (int(u) + 1) / 10) < 1e-9 for u, r in got.items())
    blank = readers.read_corpus(spark, str(tmp_path)).withColumn("duration", F.when(F.col("uid") == "5", 9.0).when(F.col("uid") < "5", 0.0))
    blank = blank.withColumn("audio_path", F.when(F.col("uid") == "2", "gone.wav").otherwise(F.col("audio_path")))
    filled = {r.uid: r.duration for r in pcm.fill_durations(blank, str(tmp_path)).collect()}
    assert filled["5"] == 9.0 and filled["2"] == 0.0 and abs(filled["0"] - 0.1) < 1e-9 and abs(filled["7"] - 0.8) < 1e-9
