"""Fact patterns of opinions by rules: the part that tells the facts, without citations, names and legal terms, and what
speaks against its use (FPT-1). Steps are columns of the row; each is made once and nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_labels as L
from ..functions.text import squeeze
from .records import tidy
from .rows import first_of


def _named(x: Column, terms: tuple[str, ...], fold: bool = True) -> Column:
    """The terms that stand in a text, in their order."""
    t = F.lower(x) if fold else x
    return F.array_compact(F.array(*[F.when(t.contains(w.lower() if fold else w), w) for w in terms]))


def _literal(term: str) -> str:
    return r"(?i)\Q" + term + r"\E"


def _begins(x: Column, pattern: str) -> Column:
    """Place of a pattern's first match from 1, 0 without one."""
    return F.regexp_instr(x, F.lit(pattern))


def section(x: Column, korean: bool) -> Column:
    """struct(text, method, reason): what stands under a heading of facts, else the first sentences, else nothing."""
    begin, end = (L.FACTS_BEGIN_KO, L.FACTS_END_KO) if korean else (L.FACTS_BEGIN_EN, L.FACTS_END_EN)
    at = _begins(x, begin)
    tail = F.substring(x, at + F.length(F.regexp_extract(x, begin, 0)), F.length(x))
    stop = _begins(tail, end)
    under = tidy(F.when(stop > 0, F.substring(tail, F.lit(1), stop - 1)).otherwise(tail))
    rest, ordered = x, F.lit(False)
    if korean:
        reason = _begins(x, L.REASON_HEADING_KO)
        rest = F.when(reason > 0, F.substring(x, reason + F.length(F.regexp_extract(x, L.REASON_HEADING_KO, 0)), F.length(x))).otherwise(x)
        ordered = squeeze(x).rlike(r"^(?:주문|청구취지)(?![가-힣A-Za-z0-9_])")
    sentences = F.filter(F.split(squeeze(rest), L.SENTENCES_OF_FACTS), lambda s: F.btrim(s) != "")
    few = F.array_join(F.slice(sentences, 1, 8 if korean else 18), " ")
    method = first_of([(x == "", "failed"), (at > 0, "heading_based"), (ordered, "failed")], "fallback")
    return F.struct(
        F.when(method == "heading_based", under).when(method == "fallback", few).otherwise("").alias("text"), method.alias("method"),
        first_of([(x == "", "empty_text"), (method != "heading_based", "no_fact_section_detected")], "").alias("reason"),
    )


def shortened(x: Column, most: Column) -> Column:
    """Whole sentences while they fit, else the first `most` characters."""
    y = squeeze(x)
    fits = F.aggregate(
        F.split(y, L.SENTENCES_OF_FACTS), F.struct(F.lit("").alias("text"), F.lit(True).alias("more")),
        lambda a, s: F.struct(
            F.when(a["more"] & (F.length(a["text"]) + F.length(s) + 1 <= most), F.btrim(F.concat_ws(" ", a["text"], s))).otherwise(a["text"]).alias("text"),
            (a["more"] & (F.length(a["text"]) + F.length(s) + 1 <= most)).alias("more"),
        ),
        lambda a: a["text"],
    )
    return F.when(F.length(y) <= most, y).when(fits != "", fits).otherwise(F.btrim(F.substring(y, F.lit(1), most)))


def fact_patterns(rows: DataFrame, korean: bool, least: int = 200, most: int = 4000) -> DataFrame:
    """case_id, fact, status (pass, warning, fail), excluded_reason, method, flags, removed and legal of rows (case_id,
    raw_text, title, court)."""
    none = F.array().cast("array<string>")
    out = rows.select("case_id", tidy("raw_text").alias("raw"), squeeze("title").alias("title"), squeeze("court").alias("court"))
    context = F.concat_ws(" ", "title", "court", "raw")
    criminal = _named(context, L.CRIMINAL_TERMS_KO if korean else L.CRIMINAL_TERMS_EN, not korean)
    cited = (squeeze("raw").rlike(r"^(?:1\. )?제1심 판결의 인용") | F.col("raw").contains("이 법원이 적을 이유는")) if korean else F.lit(False)
    out = out.withColumns({"criminal": criminal, "cited": cited, "part": section(F.col("raw"), korean)}).withColumns({"fact": F.col("part.text"), "removed": none})

    def strip(df: DataFrame, patterns, by: str = " ") -> DataFrame:
        found = [F.transform(F.regexp_extract_all("fact", F.lit(p), F.lit(0)), squeeze) for p in patterns]
        df = df.withColumn("removed", F.concat("removed", *found))
        text = F.col("fact")
        for p in patterns:
            text = F.regexp_replace(text, p, by)
        return df.withColumn("fact", tidy(text))

    out = strip(out, L.STRIPPED)
    if korean:
        for pattern in (L.FACTS_END_KO, L.ANALYSIS_KO):
            at = _begins(F.col("fact"), pattern)
            out = out.withColumns({"removed": F.when(at > 0, F.concat("removed", F.array(squeeze(F.substring(F.col("fact"), at, F.length("fact")))))).otherwise(F.col("removed")), "fact": F.when(at > 0, F.substring(F.col("fact"), F.lit(1), at - 1)).otherwise(F.col("fact"))})
        out = strip(strip(out, L.STRIPPED_KO), [r"\Q" + t + r"\E" for t in (*L.ORDER_TERMS_KO, *L.BASIS_TERMS_KO)])
        out = strip(out, L.BOILERPLATE_KO)
        text = F.col("fact")
        for p, by in L.LEFTOVERS_KO:
            text = F.regexp_replace(text, p, by)
        out = out.withColumn("fact", F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"^[ ,.;:：]+|[ ,.;:：]+$", ""))
    for c in ("title", "court"):
        there = (F.length(c) >= 4) & F.col("fact").contains(F.col(c))
        out = out.withColumns({"removed": F.when(there, F.concat("removed", F.array(c))).otherwise(F.col("removed")), "fact": F.when(there, F.replace(F.col("fact"), F.col(c), F.lit(" "))).otherwise(F.col("fact"))})
    out = out.withColumn("removed", F.concat("removed", _named(F.col("fact"), L.JURISDICTION_TERMS)))
    text = F.col("fact")
    for term in L.JURISDICTION_TERMS:
        text = F.regexp_replace(text, _literal(term), " ")
    out = out.withColumn("fact", tidy(text))
    out = out.withColumn("removed", F.concat("removed", _named(F.col("fact"), tuple(a for a, _ in L.NEUTRAL_TERMS))))
    text = F.col("fact")
    for term, by in L.NEUTRAL_TERMS:
        text = F.regexp_replace(text, _literal(term), by)
    limit = F.when(F.lit(korean) & (F.col("part.method") == "fallback"), F.least(F.lit(most), F.lit(1200))).otherwise(F.lit(most))
    out = out.withColumn("fact", shortened(tidy(text), limit))

    legal, place = _named(F.col("fact"), L.LEGAL_TERMS), _named(F.col("fact"), L.JURISDICTION_TERMS)
    ordered = (F.size(_named(F.col("fact"), L.ORDER_TERMS_KO, False)) > 0) if korean else F.lit(False)
    procedural = F.lit(False)
    if korean:
        procedural = (F.col("fact") != "") & (F.col("fact").rlike(L.PROCEDURAL_KO) | ((F.size(_named(F.col("fact"), L.PROCEDURAL_TERMS_KO, False)) >= 2) & (F.length("fact") < 1200)))
    method, size = F.col("part.method"), F.length("fact")
    out = out.withColumns({"legal": legal, "place": place, "ordered": ordered, "procedural": procedural})
    review = (method != "heading_based") | (F.size("legal") > 0) | (F.size("place") > 0) | F.col("ordered") | F.col("procedural")
    barred = (F.size("criminal") > 0) | F.col("cited")
    own = [
        (F.col("ordered"), "contains_order_or_claim_section"), ((method == "failed") | (size == 0) | F.col("procedural"), "extraction_failed"), (F.size("place") > 0, "jurisdiction_signal_may_remain"),
        (F.size("legal") > 0, "legal_conclusion_may_remain"), (F.size("legal") > 0, "legal_term_leakage"), (review, "manual_review_recommended"), (method != "heading_based", "no_fact_section_detected"),
        (size >= most, "too_long"), (size < least, "too_short"), (F.lit(True), "translation_needed"),
    ]
    early = F.when(F.size("criminal") > 0, F.array(F.lit("contains_criminal_signal"), F.lit("extraction_failed"))).otherwise(F.array(F.lit("extraction_failed"), F.lit("manual_review_recommended")))
    flags = F.when(barred, early).otherwise(F.array_compact(F.array(*[F.when(c, n) for c, n in own])))
    fails = barred | F.col("procedural") | (size < least) | (size == 0)
    status = F.when(fails, "fail").when(review | (size >= most), "warning").otherwise("pass")
    reason = first_of([(F.size("criminal") > 0, "criminal_case_signal"), (F.col("cited"), "procedural_section_signal"), ((size == 0) & (F.col("part.reason") == ""), "empty_fact_candidate")])
    reason = F.coalesce(reason, F.when(F.col("procedural") & (size > 0), "procedural_only_fact_candidate"), F.nullif(F.col("part.reason"), F.lit("")), F.lit("fact_candidate_failed_qc"))
    return out.select("case_id", F.when(~fails, F.col("fact")).alias("fact"), status.alias("status"), F.when(fails, reason).otherwise("").alias("excluded_reason"), method.alias("method"), flags.alias("flags"), F.array_distinct("removed").alias("removed"), "legal")
