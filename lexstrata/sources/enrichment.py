"""Enrichment by an external model as a relational step: request keys, cached answers, validation (section 2.16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_keys(requests: DataFrame, *parts: str) -> DataFrame:
    """requests with request_key, the SHA-256 of its parts as JSON with sorted names."""
    return requests.withColumn("request_key", F.sha2(F.to_json(F.struct(*sorted(parts)), {"ignoreNullFields": "false"}), 256))


def pending(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that the cache has no valid answer for, each key once (FLT-7)."""
    return requests.dropDuplicates(["request_key"]).join(cache.filter("valid"), "request_key", "left_anti")


def answered(requests: DataFrame, cache: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Requests with their parsed answer, its missing fields and whether it is valid (JSN-3)."""
    parsed = requests.join(cache.select("request_key", "response"), "request_key", "left").withColumn("answer", F.from_json("response", schema))
    missing = F.array_compact(F.array(*[F.when(F.col(f"answer.{c}").isNull(), F.lit(c)) for c in required]))
    return parsed.withColumn("missing", missing).withColumn("valid", F.col("response").isNotNull() & (F.size("missing") == 0))


def reconciled(primary: DataFrame, secondary: DataFrame, adjudication: DataFrame, key: str, label: str) -> DataFrame:
    """Final label of two reviews and an adjudication of their disagreements: key, label, basis."""
    j = primary.select(key, F.col(label).alias("p")).join(secondary.select(key, F.col(label).alias("s")), key, "left").join(adjudication.select(key, F.col(label).alias("a")), key, "left")
    same = F.col("p").eqNullSafe(F.col("s"))
    return j.select(key, F.when(same, F.col("p")).otherwise(F.coalesce("a", "p")).alias(label), F.when(same, "agreed").when(F.col("a").isNotNull(), "adjudicated").when(F.col("s").isNull(), "primary_only").otherwise("unresolved").alias("basis"))


def mocked(requests: DataFrame, fixtures: DataFrame, stage: str, key: str) -> DataFrame:
    """Requests with the answer that a table of fixtures (stage, key, response) holds for a stage; a missing one is null
    and so invalid (SRC-15)."""
    own = fixtures.filter(F.col("stage") == stage).select(key, "response")
    return requests.join(own, key, "left")
