"""Sinks: guarded writes, canonical JSON, CSV with nested cells, fan-out and hash manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which executors share; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/step-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='lexstrata-')}/step"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a scratch folder: cuts lineage, so a lost executor costs one step's tasks."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def write_guarded(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet, an error if the path exists and may not be overwritten (SNK-1, SNK-4); a job's commit is atomic."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def canonical_json(df: DataFrame) -> DataFrame:
    """One column `json` with keys sorted at the top level (STR-5, SNK-1)."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON cells and nulls as empty cells (SNK-3)."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*cells).write.csv(path, header=True, nullValue="", emptyValue="", escape='"')


def append(df: DataFrame, path: str) -> None:
    """Rows added to a log (SNK-2, SNK-14)."""
    df.write.mode("append").parquet(path)


def write_by_value(df: DataFrame, path: str, *columns: str) -> None:
    """One folder per value of the columns (SNK-15)."""
    df.write.partitionBy(*columns).parquet(path)


def merge_errors(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both logs with one row per key (SNK-6)."""
    return old.unionByName(new, allowMissingColumns=True).dropDuplicates(keys)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of every file below a folder (SNK-10)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def drift(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Files that a frozen manifest and the present one don't share alike: path, state (SNK-10)."""
    a, b = frozen.select("path", F.col("sha256").alias("was")), now.select("path", F.col("sha256").alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "missing").otherwise("changed")
    return a.join(b, "path", "full_outer").filter(~F.col("was").eqNullSafe(F.col("now"))).select("path", state.alias("state"))


def version_path(existing: list[str], path: str) -> str:
    """The path, or with the first free `_attemptN` (SNK-11)."""
    if path not in existing:
        return path
    n = 2
    while f"{path}_attempt{n}" in existing:
        n += 1
    return f"{path}_attempt{n}"
