"""File sources: JSON lines, CSV as text, Parquet shards, Markdown with front matter."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (e.getCondition() or "") or "Path does not exist" in str(e)


def read_jsonl(spark: SparkSession, path: str, schema: str, empty_if_missing: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed one is an error, a missing file is empty (SRC-1)."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").option("encoding", "UTF-8").json(path)
    except AnalysisException as e:
        if empty_if_missing and _missing(e):
            return spark.createDataFrame([], schema)
        raise


def read_jsonl_recover(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """Rows of a log whose last line may be torn off, and how many were (0 or 1); other bad lines are an error (SRC-2)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n")).filter("trim(value) <> ''")
    bad_field = "__bad"
    kind = T.StructType.fromDDL(schema).add(bad_field, T.StringType())
    parsed = lines.withColumn("row", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad_field}))
    bad = F.col(f"row.{bad_field}").isNotNull()
    last = lines.groupBy("file").agg(F.max("n").alias("last"))
    found = parsed.filter(bad).join(last, "file").agg(F.count(F.lit(1)).alias("bad"), F.count_if(F.col("n") < F.col("last")).alias("inside")).first()
    if found["inside"]:
        raise ValueError(f"{found['inside']} malformed lines before the last one")
    return parsed.filter(~bad).select("row.*").drop(bad_field), int(found["bad"])


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text, quoted cells over several lines, without a byte-order mark (SRC-3)."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_shards(spark: SparkSession, paths: list[str], first: int = 0) -> DataFrame:
    """Parquet shards united by name, sorted; with `first` only so many, and a column that says so (SRC-4, SRC-5)."""
    chosen = sorted(paths)[:first] if first > 0 else sorted(paths)
    return spark.read.option("mergeSchema", True).parquet(*chosen).withColumn("partial", F.lit(0 < first < len(paths)))


def read_markdown(spark: SparkSession, path: str, section: str = "판례내용", limit: int = 0) -> DataFrame:
    """path, fields (map of the front matter's plain `key: value` lines) and body (a section's text) of Markdown files, in
    the order of their paths (SRC-7, SRC-8)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if limit:
        files = files.orderBy("path").limit(limit)
    front = F.regexp_extract("value", r"(?s)\A﻿?---\s*\n(.*?)\n---\s*\n", 1)
    lines = F.filter(F.split(front, "\n"), lambda x: x.rlike(r"^[^\s#:][^:]*:"))
    key, value = (lambda x: F.btrim(F.regexp_extract(x, r"^([^:]+):", 1))), (lambda x: F.btrim(F.regexp_extract(x, r"^[^:]+:\s*[\"']?(.*?)[\"']?\s*$", 1)))
    fields = F.map_from_entries(F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))))
    body = F.regexp_extract("value", rf"(?ms)^## {section}\s*$\n?(.*?)(?=^## |\z)", 1)
    return files.select("path", fields.alias("fields"), F.btrim(body, F.lit(" \n\r\t")).alias("body"))


def read_arrow(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of Arrow files or streams, in the order of their names (SRC-6): read on the executors as bytes and decoded
    there batch by batch; the schema comes from the first file."""
    import pyarrow as pa

    def opened(content: bytes):
        source = pa.BufferReader(content)
        return pa.ipc.open_file(source) if content[:6] == b"ARROW1" else pa.ipc.open_stream(source)

    def batches_of(reader):
        return (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else iter(reader)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                yield from batches_of(opened(content.as_py()))

    files = spark.read.format("binaryFile").load(sorted(paths)).select("content")
    from pyspark.sql.pandas.types import from_arrow_schema

    return files.mapInArrow(run, from_arrow_schema(opened(files.first()["content"]).schema))


def scan(spark: SparkSession, path: str, columns: list[str], filters: list[tuple[str, str, object]]) -> DataFrame:
    """Some columns of the rows that pass (column, operator, value) filters; both reach the Parquet reader (SRC-11)."""
    ops = {"==": "eqNullSafe", "=": "eqNullSafe", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "in": "isin"}
    df = spark.read.parquet(path)
    for name, op, value in filters:
        df = df.filter(getattr(F.col(name), ops[op])(value))
    return df.select(*columns)


def read_document(spark: SparkSession, path: str) -> dict:
    """A single JSON object, such as a configuration (SRC-12)."""
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_quotas(spark: SparkSession, path: str) -> dict:
    """A sampling configuration whose quotas must add up to its target (SRC-13)."""
    config = read_document(spark, path)
    quotas = config.get("quotas")
    if not isinstance(quotas, dict) or sum(map(int, quotas.values())) != int(config.get("target_count", 0)):
        raise ValueError("the quotas must add up to target_count")
    return config


def revision(head: str, loose: dict[str, str], packed: str) -> str:
    """Commit that a repository's HEAD names: a loose ref, else a packed one, else HEAD itself (SRC-14)."""
    name = head.strip().removeprefix("ref: ")
    if name == head.strip():
        return name
    lines = (x.split(" ", 1) for x in packed.splitlines() if x[:1] not in ("", "#", "^"))
    return loose.get(name, "").strip() or next((sha for sha, ref in lines if ref == name), head.strip())


def artifacts(tables: dict[str, list[DataFrame]], key: str = "case_id") -> dict[str, DataFrame]:
    """Each kind's tables as one, with a row per key; later tables win (SRC-16)."""
    out = {}
    for kind, parts in tables.items():
        rows = None
        for i, p in enumerate(parts):
            own = p.withColumn("__turn", F.lit(i))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        names = [c for c in rows.columns if c not in (key, "__turn")]
        last = F.max_by(F.struct(*names), F.col("__turn")).alias("__last")
        out[kind] = rows.groupBy(key).agg(last).select(key, *[F.col(f"__last.{c}").alias(c) for c in names])
    return out
