"""Entity and relation tables: identifiers, placeholders, pruning and referential checks (GPH-1, BIL-4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import alpha_suffix

#: Relation types whose direction is turned: (type, type after the turn).
TURNED = (("employed_by", "employs"), ("owned_by", "owns"), ("treated_by", "treats"), ("injured_by", "injures"))


def named_entities(entities: DataFrame, by_name: bool = True, suffix: Callable[[str], Column] = alpha_suffix) -> DataFrame:
    """case_id, old_id, entity_id (E001..) and placeholder ([KIND_A]..) in the order of position, one per (case, kind, name),
    or without by_name one per row, as namesakes may be different ones. Nulls come last; `suffix` says a number in letters."""
    name = F.lower("name").alias("name")
    if by_name:
        first = entities.groupBy("case_id", "kind", name).agg(F.min("position").alias("position"), F.collect_set("entity_id").alias("old_ids"))
    else:
        first = entities.select("case_id", "kind", name, "position", F.array("entity_id").alias("old_ids"))
    position, kind, name, own = (F.asc_nulls_last(c) for c in ("position", "kind", "name", "old_ids"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy(position, kind, name, own))
    k = F.row_number().over(Window.partitionBy("case_id", "kind").orderBy(position, name, own))
    out = first.withColumns({"n": n, "k": k})
    return out.select("case_id", F.explode("old_ids").alias("old_id"), F.format_string("E%03d", "n").alias("entity_id"), F.concat(F.lit("["), F.upper("kind"), F.lit("_"), suffix("k"), F.lit("]")).alias("placeholder"))


def normal_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between known entities under their new ids: turned to one direction, loops dropped, each once, R001.. ."""
    ids = entities.select("case_id", "old_id", "entity_id")
    s = ids.toDF("case_id", "subject", "s")
    o = ids.toDF("case_id", "object", "o")
    j = relations.join(s, ["case_id", "subject"]).join(o, ["case_id", "object"])
    turned, kind = F.lit(False), F.col("relation")
    for a, b in TURNED:
        turned, kind = turned | (F.col("relation") == a), F.when(F.col("relation") == a, b).otherwise(kind)
    flat = j.select("case_id", F.when(turned, F.col("o")).otherwise(F.col("s")).alias("subject"), kind.alias("relation"), F.when(turned, F.col("s")).otherwise(F.col("o")).alias("object"), "material")
    once = flat.filter("subject <> object").groupBy("case_id", "subject", "relation", "object").agg(F.bool_or("material").alias("material"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("subject", "relation", "object"))
    return once.withColumn("relation_id", F.format_string("R%03d", n))


def dangling(children: DataFrame, parents: DataFrame, case: str, ids: str, parent_id: str) -> DataFrame:
    """Per case, the ids that child rows name and no parent has, sorted (BIL-4)."""
    named = children.select(case, F.explode(ids).alias(parent_id)).distinct()
    lost = named.join(parents.select(case, parent_id).distinct(), [case, parent_id], "left_anti")
    return lost.groupBy(case).agg(F.array_sort(F.collect_list(parent_id)).alias("missing"))
