"""Session defaults and the shared scratch area."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "corpusloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """Session for local use; on a cluster the submitter's own settings hold."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process wrote and that go with it: (path, JVM file system).
_written: list[tuple[str, object]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master without one gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, with its scheme. What is written there is deleted by clear_scratch() or when the driver ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = store.makeQualified(path)
    if not _written:
        atexit.register(clear_scratch)
    _written.append((path, store))
    return path.toString()


def clear_scratch() -> None:
    """Delete every table that materialize() wrote in this process; frames that read them are void afterwards."""
    while _written:
        path, store = _written.pop()
        with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended, and its file system with it
            store.delete(path, True)


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it holds at most max_rows rows, else df as it is for a shuffled join.

    The count looks at max_rows + 1 rows at most; df should be a written table or cheap to compute.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
