"""Preprocessed records of opinions: cleaned text, the part that reasons, counts and what metadata the text gives (PRE-1).

All of a record is built from Column expressions over the row's own text; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import fixed_labels as L
from ..functions.scalars import let
from ..functions.text import col
from .rows import first_of


def tidy(x: Column | str) -> Column:
    """Spacing made even and paragraph bounds kept; HTML entities of markup and spaces resolved."""
    y = F.coalesce(col(x), F.lit(""))
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        y = F.replace(y, F.lit(entity), F.lit(c))
    for pattern, by in (("﻿", ""), (" ", " "), (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        y = F.regexp_replace(y, pattern, by)
    return F.regexp_replace(y, r"^\s+|\s+\z", "")


def cleaned(x: Column, korean: bool) -> Column:
    """Text without appendices, notes and page marks."""
    y = x
    for pattern, by in [(p, "") for p in L.APPENDIX_KO] if korean else L.NOTES_EN:
        y = F.regexp_replace(y, pattern, by)
    return tidy(y)


def reasoning(x: Column, korean: bool) -> Column:
    """struct(text, found): what follows the heading of the reasons, or begins with the mark of an opinion's body, else all."""
    if korean:
        after = [(F.regexp_instr(x, F.lit(p)), F.length(F.regexp_extract(x, p, 0))) for p in L.REASONS_KO]
        judged = F.regexp_instr(x, F.lit(L.JUDGMENT_KO))
        start = F.coalesce(*[F.when(at > 0, at + n) for at, n in after], F.when(judged > 0, judged))
    else:
        # the first mark that a line after the caption begins with, else the first of all
        mark = rf"\s*(?:{L.OPINION_EN})\s*$"
        later = F.regexp_instr(F.substring(x, F.lit(101), F.length(x)), F.lit(rf"(?im)(?<=\n){mark}")) + 100
        later, first = F.when(later > 100, later).otherwise(0), F.regexp_instr(x, F.lit(rf"(?im)^{mark}"))
        start = F.coalesce(F.when(later > 0, later), F.when(first > 0, first))
    return F.struct(F.when(start.isNotNull(), tidy(F.substring(x, start, F.length(x)))).otherwise(x).alias("text"), start.isNotNull().alias("found"))


def sentence_count(x: Column) -> Column:
    """Sentences by their ends before a capital, Hangul or an opening mark; abbreviations end none."""
    y = x
    for a in L.ABBREVIATIONS:
        y = F.replace(y, F.lit(a), F.lit(a.replace(".", "<")))
    return F.when(F.length(x) == 0, 0).otherwise(F.size(F.filter(F.split(y, L.SENTENCE_END), lambda s: F.btrim(s) != "")))


def keywords(x: Column, words: tuple[str, ...]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(x.contains(w), w) for w in words])), "; ")


def level_ko(court: Column, text: Column, number: Column) -> Column:
    code = F.regexp_extract(number, r"\d{4}\s*([가-힣]{1,5})\s*\d+", 1)
    signs = F.regexp_extract_all(F.substring(text, 1, 5000), F.lit(r"항소취지|원고의\s*항소|피고의\s*항소|제1심\s*판결[^.]{0,80}(?:취소|변경)|항소를\s*기각|항소비용"), F.lit(0))
    return first_of([
        (code == "다", "supreme"), (code == "나", "appellate"), (code.isin("가합", "가단", "가소"), "trial"), (court.contains("대법원"), "supreme"), (court.contains("고등법원"), "appellate"),
        (F.size(F.array_distinct(signs)) >= 2, "appellate"), (text.rlike("지방법원|지원|1심"), "trial"),
    ], "unknown")


def level_us(court: Column, given: Column) -> Column:
    c = F.lower(court)
    named = first_of([(c.contains("supreme court"), "supreme"), (c.contains("court of appeals") | c.contains("cir."), "appellate"), (c.rlike("district court|bankruptcy court"), "trial")], "unknown")
    return F.coalesce(F.nullif(F.lower(tidy(given)), F.lit("")), named)


def iso_date(x: Column) -> Column:
    """A date written with hyphens or dots as yyyy-mm-dd, else the text itself."""
    parts = [F.regexp_extract(x, r"(\d{4})(?:-|\.\s*)(\d{1,2})(?:-|\.\s*)(\d{1,2})", k) for k in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))).otherwise(tidy(x))


def preprocessed(rows: DataFrame, korean: bool, least: int = 500) -> DataFrame:
    """Records of rows (case_id, raw_text, court_name, decision_date, number, level; the last four may be null)."""
    none = lambda c: F.coalesce(tidy(c), F.lit(""))
    tokens = lambda x: F.size(F.regexp_extract_all(x, F.lit(X.TOKEN), F.lit(0)))
    raw = rows.select("case_id", tidy("raw_text").alias("raw"), *[none(c).alias(c) for c in ("court_name", "decision_date", "number", "level")])
    text = raw.withColumn("clean", cleaned(F.col("raw"), korean)).withColumn("part", reasoning(F.col("clean"), korean))
    head = F.substring("raw", 1, 1600)
    if korean:
        number = F.regexp_extract(head, L.NUMBER_KO, 1)
        court = F.coalesce(first_of([(F.substring("raw", 1, 500).contains(c), c) for c in L.COURTS_KO]), F.lit(""))
        dated = F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in L.DECIDED_KO], F.lit(""))
    else:
        number = F.coalesce(*[F.nullif(F.regexp_extract("raw", "(?i)" + p, 0), F.lit("")) for p in L.CITATIONS_EN], F.lit(""))
        court, dated = F.lit(""), F.lit("")
    given = lambda c, own: F.coalesce(F.nullif(F.col(c), F.lit("")), own)
    known = text.withColumns({"number": given("number", tidy(number)), "court_name": given("court_name", court), "decision_date": iso_date(given("decision_date", dated))})
    level = level_ko(F.col("court_name"), F.col("raw"), F.col("number")) if korean else level_us(F.col("court_name"), F.col("level"))
    counts = let({"c": tokens(F.col("clean")), "s": sentence_count(F.col("clean")), "t": tokens(F.col("part.text")), "r": sentence_count(F.col("part.text"))}, lambda h: h)
    out = known.withColumn("counts", counts)
    few = F.col("counts.t") < least
    notes = F.array(F.when(F.col("part.found"), "reasoning_marker_found").otherwise("reasoning_marker_missing_used_clean_text"), F.when(F.col("clean").contains("[별지 생략]") | F.col("clean").rlike(r"(?m)^별\s*지\s*$"), "possible_appendix_remaining"), F.when(few, f"below_min_reasoning_tokens_{least}"))
    return out.select(
        "case_id", F.lit("KR" if korean else "US").alias("jurisdiction"), "court_name", given("level", level).alias("court_level") if korean else level.alias("court_level"), "decision_date", F.col("number").alias("case_number_or_citation"),
        keywords(F.col("raw"), L.KEYWORDS_KO).alias("keywords") if korean else keywords(F.lower("raw"), L.KEYWORDS_EN).alias("keywords"),
        F.col("clean").alias("clean_text"), F.col("part.text").alias("reasoning_text"), F.length("raw").alias("raw_char_count"), F.length("clean").alias("clean_char_count"), F.length("part.text").alias("reasoning_char_count"),
        F.col("counts.c").alias("clean_token_count"), F.col("counts.s").alias("clean_sentence_count"), F.col("counts.t").alias("token_count"), F.col("counts.r").alias("sentence_count"),
        F.when(F.col("counts.r") > 0, F.round(F.col("counts.t") / F.col("counts.r"), 2)).otherwise(0.0).alias("avg_sentence_length"), F.col("part.found").alias("has_marker"), (~few).alias("meets_min_reasoning_tokens"), F.array_join(F.array_compact(notes), "; ").alias("notes"),
    )
