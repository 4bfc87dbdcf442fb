"""Shared helpers: table reads, steps written to the cluster's shared folder, and release of finished shuffles."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset (local tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="lexstrata-"))
    return f"file://{_own_folder[0]}"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors.

    tidy: for steps with large shuffles, whose files then go before the next step begins."""
    spark = df.sparkSession
    if tidy:
        release(spark)  # what the step before this one left
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if tidy:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of steps that nothing refers to any more; a second round a little later,
    as events under way still name a step when it has just ended."""
    for wait in (0.5, 0.2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def tasks(spark: SparkSession, least: int = 1) -> int:
    """A number of tasks for a shuffle, as the session sets it."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark send Python at most so many rows at once, or fewer if the session says so: with whole texts a batch is
    held up to four times, in the JVM and in Python, by each task. The setting stays, as plans run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def trim() -> None:
    """Gives memory that this process has freed back to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: the memory is used again, not given back


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
