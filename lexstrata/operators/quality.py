"""Quality checks across tables: invariants, responses, adjudication, reviews and allow-listed changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import changed_fields, first_of

#: Ordinal scales, from best to worst.
SCALES = {"status": ("pass", "warning", "fail", "missing"), "risk": ("low", "medium", "high"), "action": ("accept", "edit", "reject")}


def invariants(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per named check: it holds if its frame of offending rows is empty (QC-5). Offenders are counted, never collected."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_offending")).select(F.lit(n).alias("invariant"), "n_offending", (F.col("n_offending") == 0).alias("holds")) for n, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failed_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails, in order; null counts as failed (QC-1..3, QC-11)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in checks.items()]))


def worst(df: DataFrame, keys: list[str], value: str, scale: str) -> DataFrame:
    """The worst value of an ordinal scale per key; unknown values count as worst of all (AGG-14, AGG-16)."""
    names = SCALES[scale]
    rank = first_of([(F.col(value) == v, str(i)) for i, v in enumerate(names)], str(len(names))).cast("int")
    return df.groupBy(*keys).agg(F.max_by(value, rank).alias(value))


def response_checks(text: Column, language: str, given_numbers: Column, own_numbers: Column, headings: Sequence[str]) -> dict[str, Column]:
    """Checks of a model's answer: language, sections, numbers it was not given, placeholders, authorities, truncation (QC-4)."""
    from ..functions import fixed as X
    from .rules import language_sanity

    present = sum((F.contains(F.lower(text), F.lit(h.lower())).cast("int") for h in headings), F.lit(0))
    return {
        "language": language_sanity(text, language) == "pass",
        "sections": present >= min(4, len(headings)),
        "no_new_numbers": F.size(F.array_except(own_numbers, given_numbers)) == 0,
        "no_authorities": ~text.rlike(X.LEGAL_EN),
        "not_cut": F.btrim(text).rlike(r"[.!?\])。다]$"),
    }


def adjudicated(df: DataFrame, hard: str, model: str) -> DataFrame:
    """df with final and basis: a deterministic failure overrides the model's verdict, which may only make it worse (QC-8, QC-15)."""
    final = F.when(F.size(hard) > 0, "fail").otherwise(F.coalesce(F.col(model), F.lit("missing")))
    basis = F.when((F.size(hard) > 0) & (F.col(model) != "fail"), "deterministic_override").when(F.size(hard) > 0, "both").when(F.col(model).isNull(), "missing").otherwise("model")
    return df.withColumn("final", final).withColumn("basis", basis)


def single_valued(df: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """Per kind, whether each field has one value (QC-9)."""
    return df.groupBy(kind).agg(*[(F.count_distinct(f) <= 1).alias(f"one_{f}") for f in fields])


def review_errors(reviews: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Reviews that can't be imported, with all reasons: repeated, unknown or stale parent, notes or text missing (QC-10, JOI-16)."""
    n = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    p = parents.select(key, F.col("sha256").alias("__sha"))
    j = reviews.join(n, key).join(p, key, "left")
    edits = F.col("action") == "edit"
    rules = {
        "repeated": F.col("__n") == 1,
        "unknown_parent": F.col("__sha").isNotNull(),
        "stale_parent": F.col("__sha").isNull() | (F.col("parent_sha256") == F.col("__sha")),
        "notes_required": (F.col("action") == "accept") | (F.coalesce(F.btrim("notes"), F.lit("")) != ""),
        "text_required": ~edits | (F.coalesce(F.btrim("text"), F.lit("")) != ""),
        "known_action": F.col("action").isin(*SCALES["action"]),
    }
    return j.select(key, failed_checks(rules).alias("errors")).filter(F.size("errors") > 0)


def unexpected_changes(before: DataFrame, after: DataFrame, key: str, allowed: dict[str, set[str]]) -> DataFrame:
    """Changed fields outside the allow list of fields per key (QC-12)."""
    pairs = [(str(k), f) for k, fs in allowed.items() for f in fs]
    found = changed_fields(before, after, key)
    if not pairs:
        return found
    ok = F.concat_ws("\x1f", F.col(key).cast("string"), "field").isin(*["\x1f".join(p) for p in pairs])
    return found.filter(~ok)


def batch_gate(df: DataFrame, hard: Column, api: Column, most_hard: float, most_api: float) -> DataFrame:
    """Rates of hard and transport failures and whether they block the batch (QC-14)."""
    rate = lambda c: F.coalesce(F.try_divide(F.count_if(c), F.count(F.lit(1))), F.lit(0.0))
    return df.agg(rate(hard).alias("hard_rate"), rate(api).alias("api_rate")).withColumn("blocked", (F.col("hard_rate") > most_hard) | (F.col("api_rate") > most_api))


def run_checks(before: DataFrame, after: DataFrame, plan: DataFrame, settings: dict[str, tuple]) -> DataFrame:
    """Named checks that a second run repeats the first but for its instruction: check, holds (QC-7).

    before, plan: case_id, language, fact_sha256 (plan also target, instruction, wanted_instruction, prompt_before,
    prompt_after); after: records of the second run; settings: name -> (first, second). Each check is one aggregation."""
    none = lambda bad: F.count_if(F.coalesce(bad, F.lit(True))) == 0
    per_case = plan.groupBy("case_id").agg(F.count_distinct("language").alias("languages"), F.count_distinct("target").alias("targets"))
    facts = plan.join(before.select("case_id", "language", F.col("fact_sha256").alias("was")), ["case_id", "language"], "left")
    cases = plan.select("case_id").distinct().join(before.select("case_id").distinct().withColumn("there", F.lit(True)), "case_id", "full_outer")
    planned = plan.select("case_id", "language").distinct().withColumn("known", F.lit(True))
    answered = after.join(planned, ["case_id", "language"], "left")
    prefixed = F.col("prompt_after") != F.concat(F.col("instruction"), F.lit("\n\n"), F.col("prompt_before"))
    checks = {
        "exact_instructions": plan.agg(none(F.col("instruction") != F.col("wanted_instruction"))),
        "each_case_has_both_languages": per_case.agg(none(F.col("languages") != 2)),
        "languages_share_the_target": per_case.agg(none(F.col("targets") != 1)),
        "case_selection_matches": cases.join(plan.select("case_id").distinct().withColumn("planned", F.lit(True)), "case_id", "left").agg(none(F.col("there").isNull() | F.col("planned").isNull())),
        "facts_unchanged": facts.agg(none(F.col("was") != F.col("fact_sha256"))),
        "only_the_prefix_differs": plan.agg(none(prefixed)),
        "answers_are_planned": answered.agg(none(F.col("known").isNull())),
    }
    parts = [df.toDF("holds").select(F.lit(n).alias("check"), "holds") for n, df in checks.items()]
    same = plan.sparkSession.createDataFrame([("settings_unchanged", all(a == b for a, b in settings.values()))], "check string, holds boolean")
    for p in parts:
        same = same.unionByName(p)
    return same
