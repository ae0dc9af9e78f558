"""Reading transcript tables: CSV, JSON lines, Parquet with unknown column names, and which of them to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small_side

#: Candidate names of a manifest's columns, the first that exists and holds a value wins.
CANDIDATES = {
    "audio_path": ["file_name", "audio_path", "path"],
    "text": ["text", "transcript", "sentence", "transcription", "normalized_text"],
    "uid": ["id", "uid"],
    "speaker": ["channel", "speaker"],
    "duration": ["duration"],
    "split": ["split"],
}


#: All of them as strings: what a manifest's JSON lines are read as, so that no scan is made to find their types.
AS_STRINGS = ", ".join(f"`{name}` string" for name in dict.fromkeys(n for names in CANDIDATES.values() for n in names))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows, globs included, holds something."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All columns as strings, with a header. A file whose values may hold line breaks can't be split; without them a large file can."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object per line; blank lines are skipped. With a schema nothing is read twice."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def first_of(df: DataFrame, names: list[str]) -> Column:
    """The first non-blank value of the columns that exist."""
    found = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def numbered(df: DataFrame, order: list[str], prefix: str = "pq_", rows_per_bucket: int = 100_000) -> DataFrame:
    """df with uid = prefix and a number of six digits or more in the order of hash buckets and, within them, of the columns given.

    Numbers are dense. They follow from the rows alone, and no task ranks more than a bucket.
    """
    buckets = max(1, -(-df.count() // rows_per_bucket))
    rows = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy("__b").agg(F.count("*").alias("c"))
    before = counts.select("__b", F.coalesce(F.sum("c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = rows.join(small_side(before, 1_000_000), "__b")  # a row for each bucket
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return rows.withColumn("uid", F.concat(F.lit(prefix), F.format_string("%06d", number))).drop("__b", "__before")


def as_manifest(df: DataFrame, split: str | None = None) -> DataFrame:
    """uid, audio_path, text, duration, split, speaker from whatever columns a table has; blank and missing values are null, durations that aren't numbers 0."""
    value = {k: first_of(df, names) for k, names in CANDIDATES.items()}
    return df.select(
        F.coalesce(value["uid"], F.regexp_extract(value["audio_path"], r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("uid"), value["audio_path"].alias("audio_path"), value["text"].alias("text"),
        F.coalesce(value["duration"].try_cast("double"), F.lit(0.0)).alias("duration"), F.coalesce(value["split"], F.lit(split)).alias("split"), F.coalesce(value["speaker"], F.lit("default")).alias("speaker"),
    )


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """A corpus folder as a manifest: split files, else all.jsonl, else Parquet below it, else metadata.csv. Raises if none is there.

    Rows of Parquet tables without a text are left out; those of a table without ids are numbered.
    """
    splits = [s for s in ("train", "dev", "test") if exists(spark, f"{root}/metadata/{s}.jsonl")]
    if splits:
        parts = [as_manifest(read_jsonl(spark, f"{root}/metadata/{s}.jsonl", AS_STRINGS), s) for s in splits]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    if exists(spark, f"{root}/metadata/all.jsonl"):
        return as_manifest(read_jsonl(spark, f"{root}/metadata/all.jsonl", AS_STRINGS))
    if exists(spark, f"{root}/*.parquet") or exists(spark, f"{root}/*/*.parquet"):
        table = read_parquet(spark, root)
        rows = as_manifest(table).where("text is not null")
        return rows if any(c in table.columns for c in CANDIDATES["uid"]) else numbered(rows, ["audio_path", "text"]).select(rows.columns)
    if exists(spark, f"{root}/metadata.csv"):
        return as_manifest(read_csv(spark, f"{root}/metadata.csv"))
    raise FileNotFoundError(f"no metadata/*.jsonl, Parquet files or metadata.csv in {root}")


def missing_artefacts(spark: SparkSession, needed: dict[str, str]) -> list[str]:
    """Of path -> stage, a line for each path that isn't there, with the stage that makes it."""
    return [f"{path} (made by {stage})" for path, stage in needed.items() if not exists(spark, path)]
