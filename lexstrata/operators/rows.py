"""Row-level operators: reasons, funnels, dedup, joins and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col


def with_reasons(df: DataFrame, rules: Sequence[tuple[str, Column]], reasons: str = "reasons", eligible: str = "eligible") -> DataFrame:
    """Each rule that a row fails adds its code; a row without codes is eligible (FLT-3). A null test counts as failed."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules]))
    return df.withColumn(reasons, codes).withColumn(eligible, F.size(codes) == 0)


def primary_reason(reasons: Column, ordered: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """Stage of the first reason: the first entry whose text the reason contains (FLT-4)."""
    first = F.try_element_at(reasons, F.lit(1))
    out = F.lit(other)
    for part, stage in reversed(ordered):
        out = F.when(first.contains(part), stage).otherwise(out)
    return F.when(first.isNotNull(), out)


def first_of(pairs: Sequence[tuple[Column, str]], other: str | None = None) -> Column:
    """Label of the first test that holds (FLT-10, FLT-11, CLS)."""
    out = F.lit(other)
    for test, label in reversed(pairs):
        out = F.when(test, label).otherwise(out)
    return out


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row of staged counts; a row counts in a stage if it passes that test and all before it (AGG-6)."""
    passed, out = F.lit(True), [F.count(F.lit(1)).alias("n_rows")]
    for name, test in stages:
        passed = passed & F.coalesce(test, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.agg(*out)


def hash_order(key: Column | str, seed: str) -> Column:
    """SHA-256 of `seed|key`: the deterministic order of samples (WIN-2)."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), col(key).cast("string")).cast("binary"), 256)


def first_per(df: DataFrame, keys: Sequence[Column | str], *order: Column) -> DataFrame:
    """The first row of each key in an order (WIN-3, DED-3). `row_number() = 1` lets Spark limit groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def top_per(df: DataFrame, keys: Sequence[Column | str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank (SRT-3, WIN-1)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def round_robin(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """n rows: the first of each group, then the second of each, .. (WIN-5). Groups give n rows at most each, so the
    one ordered limit sees groups x n rows."""
    ranked = top_per(df, [group], n, *order, rank="turn")
    return ranked.orderBy("turn", group).limit(n)


def quota_fill(df: DataFrame, group: str, quotas: dict[str, int], target: int, *order: Column) -> DataFrame:
    """Each group's quota in an order, then the rest of the target from all others in that order (SMP-1)."""
    quota = F.coalesce(reduce(lambda a, kv: F.when(F.col(group) == kv[0], kv[1]).otherwise(a), quotas.items(), F.lit(None).cast("int")), F.lit(0))
    ranked = top_per(df, [group], max(target, *quotas.values()), *order, rank="__rank")
    ranked = ranked.withColumn("pool", F.when(F.col("__rank") <= quota, "quota").otherwise("fill"))
    return ranked.orderBy((F.col("pool") != "quota").cast("int"), *order).limit(target).drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new in place of those of equal key (SNK-5, SNK-7)."""
    return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def changed_fields(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """A row for each common key and field that differs: key, field (PRJ-12, QC-6)."""
    fields = [c for c in before.columns if c != key and c in after.columns]
    both = before.alias("b").join(after.alias("a"), key)
    differ = F.array_compact(F.array(*[F.when(~F.col(f"b.`{c}`").eqNullSafe(F.col(f"a.`{c}`")), F.lit(c)) for c in fields]))
    return both.select(key, F.explode(differ).alias("field"))


def key_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side (JOI-3, JOI-4)."""
    a = left.select(key).distinct().withColumn("__l", F.lit(1))
    b = right.select(key).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.filter(F.col("__l").isNull() | F.col("__r").isNull()).select(key, F.when(F.col("__l").isNull(), "right").otherwise("left").alias("only_in"))


def unique_links(left: DataFrame, right: DataFrame, left_id: str, right_id: str, values: str) -> DataFrame:
    """Links by exploded identifiers, where an identifier names exactly one row on the right; the least right id of each
    left row is kept (JOI-9, DED-13)."""
    a = left.select(left_id, F.explode(values).alias("value")).distinct()
    b = right.select(right_id, F.explode(values).alias("value")).distinct()
    one = b.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(right_id).alias(right_id)).filter("n = 1")
    return a.join(one, "value").groupBy(left_id).agg(F.min(right_id).alias(right_id))


def positional_zip(left: DataFrame, right: DataFrame, by: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides paired by their place in each group; the longer side's rest is dropped (JOI-11)."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(right_order)))
    return a.join(b, [by, "place"])


def overlaps(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of spans of one document that overlap (JOI-14): key, a_id, b_id. Equi-join on the document, range condition."""
    a, b = (spans.select(key, *[F.col(c).alias(f"{x}_{c}") for c in ("id", "start", "end")]) for x in "ab")
    return a.join(b, key).filter((F.col("a_id") < F.col("b_id")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))


def largest_remainder(counts: DataFrame, group: str, n: str, target: int) -> DataFrame:
    """Seats for each group in proportion to its count, by largest remainders, ties by name (SMP-11)."""
    total = F.sum(n).over(Window.partitionBy())
    base = counts.withColumn("__q", F.col(n) * target / total).withColumn("seats", F.floor("__q").cast("long"))
    left = F.lit(target) - F.sum("seats").over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.col("__q") - F.col("seats")), F.col(group))
    return base.withColumn("seats", F.col("seats") + (F.row_number().over(order) <= left).cast("long")).drop("__q")


def majority_of_three(df: DataFrame, keys: list[str], replicate: str, value: str) -> DataFrame:
    """Value that two of replicates 1, 2, 3 share, else what went wrong (AGG-12)."""
    a, b, c = (F.max(F.when(F.col(replicate) == k, F.col(value))) for k in (1, 2, 3))
    g = df.groupBy(*keys).agg(a.alias("v1"), b.alias("v2"), c.alias("v3"))
    none = F.col("v1").isNull() | F.col("v2").isNull() | F.col("v3").isNull()
    agreed = F.when(F.col("v1").eqNullSafe(F.col("v2")) | F.col("v1").eqNullSafe(F.col("v3")), F.col("v1")).when(F.col("v2").eqNullSafe(F.col("v3")), F.col("v2"))
    return g.select(*keys, F.when(~none, agreed).alias("consensus"), F.when(none, "incomplete_replicates").when(agreed.isNull(), "replicate_disagreement").otherwise("agreed").alias("status"))


def modal(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value, ties to the one met first (AGG-11)."""
    g = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    return g.groupBy(*keys).agg(F.max_by(value, F.struct("__n", -F.col("__first"))).alias("mode"), F.max("__n").alias("n_mode"))


def multi_key_groups(df: DataFrame, row: str, keys: Sequence[str]) -> DataFrame:
    """Rows that share a value of any key with another row: row, n_keys, keys (DED-4). Nulls and empties never match."""
    parts = [df.select(row, F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]
    long = reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull() & (F.col("value") != ""))
    shared = long.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return long.join(shared, ["key", "value"]).groupBy(row).agg(F.count(F.lit(1)).alias("n_keys"), F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))


def numbered(df: DataFrame, *order: str, bucket: Column | None = None) -> DataFrame:
    """df with column number: places from 1 in the order of columns. Rows fall into ranges by `bucket`, which must not
    fall as the order rises (by default the first four characters of the first column, a hex hash); counts per range and
    ranks within a range give the number, so no window spans the table (PRJ-14, WIN-8)."""
    rows = df.withColumn("__range", F.substring(order[0], 1, 4) if bucket is None else bucket)
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    placed = rows.withColumn("__rank", rank).join(counts.select("__range", before.alias("__before")), "__range")
    return placed.withColumn("number", F.col("__before") + F.col("__rank")).drop("__range", "__rank", "__before")


def nonempty_rate(df: DataFrame, *arrays: Column | str) -> DataFrame:
    """How many of the arrays are not empty, over all rows, divided by the rows; 0 without rows (AGG-17)."""
    some = sum((F.coalesce(F.size(col(a)) > 0, F.lit(False)).cast("int") for a in arrays), F.lit(0))
    return df.agg(F.coalesce(F.round(F.try_divide(F.sum(some), F.count(F.lit(1))), 6), F.lit(0.0)).alias("rate"))


def merged_summaries(parts: DataFrame, keys: Sequence[str], sums: Sequence[str], most: Sequence[str]) -> DataFrame:
    """Partial summaries as one: counts add up, peaks take the highest (AGG-24). Top lists are made again from rows, as
    merging cut lists loses their tails."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows by hash order (SMP-2); each task sends its own first n."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def spread_sample(df: DataFrame, group: str, period: str, key: str, quotas: dict[str, int], target: int, seed: str) -> DataFrame:
    """Each group's quota by turns over its periods, then others by hash up to the target: df's rows with `pool` (SMP-3)."""
    quota = F.coalesce(reduce(lambda a, kv: F.when(F.col(group) == kv[0], kv[1]).otherwise(a), quotas.items(), F.lit(None).cast("int")), F.lit(0))
    most = max(target, *quotas.values())
    turns = top_per(df, [group, period], most, hash_order(key, seed), F.col(key), rank="__turn")
    ranked = turns.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy("__turn", period, key)))
    chosen = ranked.withColumn("pool", F.when(F.col("__place") <= quota, "quota").otherwise("fill"))
    return chosen.orderBy((F.col("pool") != "quota").cast("int"), hash_order(key, seed), key).limit(target).drop("__turn", "__place")


def with_fallback(df: DataFrame, primary: Column, group: str, period: str, key: str, quotas: dict[str, int], target: int, seed: str) -> DataFrame:
    """spread_sample of the rows that pass `primary`, and of the others for what is then lacking (SMP-3)."""
    first = spread_sample(df.filter(primary), group, period, key, quotas, target, seed).withColumn("source", F.lit("primary"))
    lacking = target - first.count()
    if lacking <= 0:
        return first
    rest = spread_sample(df.filter(~F.coalesce(primary, F.lit(False))), group, period, key, quotas, lacking, seed + "+")
    return first.unionByName(rest.withColumn("source", F.lit("fallback")))


def shortages(chosen: DataFrame, available: DataFrame, group: str, quotas: dict[str, int]) -> DataFrame:
    """Per group with a quota: quota, available, selected and what is short (SMP-3, SMP-4)."""
    spark = chosen.sparkSession
    wanted = spark.createDataFrame(sorted(quotas.items()), f"{group} string, quota int")
    n = lambda d, name: d.groupBy(group).agg(F.count(F.lit(1)).alias(name))
    j = wanted.join(n(available, "available"), group, "left").join(n(chosen, "selected"), group, "left").fillna(0)
    return j.withColumn("shortage", F.greatest(F.col("quota") - F.col("selected"), F.lit(0)))


def capped_quota(df: DataFrame, group: str, kind: str, key: str, quotas: dict[str, int], caps: dict[str, int], cap: int, target: int, seed: str) -> DataFrame:
    """Each group's quota by hash order, with at most `caps` (else `cap`) rows of a kind; groups in the order of the quotas
    while the target lasts (SMP-4). A kind belongs to one group, so the caps are ranks within kinds."""
    most = F.coalesce(reduce(lambda a, kv: F.when(F.col(kind) == kv[0], kv[1]).otherwise(a), caps.items(), F.lit(None).cast("int")), F.lit(cap))
    order = [hash_order(key, seed), F.col(key)]
    own = top_per(df.filter(F.col(group).isin(*quotas)), [group, kind], max(cap, *caps.values()), *order, rank="__kind").filter(F.col("__kind") <= most)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    turn = reduce(lambda a, kv: F.when(F.col(group) == kv[1], kv[0]).otherwise(a), list(enumerate(quotas)), F.lit(None).cast("int"))
    quota = reduce(lambda a, kv: F.when(F.col(group) == kv[0], kv[1]).otherwise(a), quotas.items(), F.lit(0))
    chosen = own.withColumn("__place", place).filter(F.col("__place") <= quota)
    return chosen.orderBy(turn, "__place").limit(target).drop("__kind", "__place")


def best_combination(pool: DataFrame, key: str, kinds: Sequence[str], seed: str, n: int = 4) -> DataFrame:
    """The n rows of a small pool with the most distinct values of each of `kinds` in turn, ties by hash of their sorted
    keys (SRT-6). The pool is joined with itself in the order of keys, at most 20 rows of it."""
    rows = pool.select(F.struct(F.col(key).cast("string").alias("key"), *kinds).alias("r")).orderBy("r.key").limit(20)
    sets = rows.select(F.array("r").alias("own"))
    for _ in range(n - 1):
        sets = sets.join(rows, F.element_at("own", -1)["key"] < F.col("r.key")).select(F.concat("own", F.array("r")).alias("own"))
    value = lambda k: lambda r: r[k]
    distinct = [-F.size(F.array_distinct(F.transform("own", value(k)))) for k in kinds]
    keys = F.transform("own", lambda r: r["key"])
    score = F.sha2(F.concat_ws("|", F.lit(seed), keys), 256)
    return sets.agg(F.min(F.struct(*[d.alias(f"d{i}") for i, d in enumerate(distinct)], score.alias("score"), keys.alias("keys"))).alias("best")).select("best.keys")
