"""The older label sets as Column expressions: posture, basis, kind, harm, stage, facts and courts (CLS-6..13, FCT-2),
and checks of translations and extracted units (BIL-3, GRD-2). Every pattern list is matched ignoring case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_labels as L
from ..functions.scalars import let, same_multiset, same_set
from ..functions.text import col, squeeze
from .rows import first_of
from .rules import numbers, placeholders, units


def _text(x: Column | str, most: int | None = None) -> Column:
    y = F.coalesce(col(x), F.lit(""))
    return F.substring(y, 1, most) if most else y


def matching(x: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns match."""
    return sum((x.rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0))


def evidence(x: Column, patterns: Sequence[str], most: int) -> Column:
    """Distinct first matches of the patterns, each cut to `most` characters, in order of the patterns."""
    found = [F.nullif(F.substring(F.regexp_extract(x, "(?i)" + p, 0), 1, most), F.lit("")) for p in patterns]
    return F.array_distinct(F.array_compact(F.array(*found)))


def _some(x: Column, patterns: Sequence[str]) -> Column:
    return matching(x, patterns) > 0


def first_with_level(rules: Sequence[tuple[Column, str, Column]]) -> tuple[Column, Column]:
    """Label and level of the first test that holds."""
    label, level = F.lit("unclear"), F.lit("low")
    for test, own, sure in reversed(rules):
        label, level = F.when(test, own).otherwise(label), F.when(test, sure).otherwise(level)
    return label, level


def _basis(posture: Column, table) -> list[tuple[Column, str]]:
    return [(posture.isin(*labels), name) for name, labels in table]


def posture_ko(x: Column | str) -> Column:
    """struct(posture, confidence, basis) of a Korean claim: exclusions in their order, then a direct claim if basis,
    conduct and harm and four of five elements are there (CLS-6)."""
    t = _text(x)
    hits = {f"h{i}": matching(t, p) for i, (_, p) in enumerate(L.POSTURE_KO)} | {f"d_{n}": _some(t, p) for n, p in L.DIRECT_KO}

    def judged(h: Column) -> Column:
        own = {n: h[f"d_{n}"] for n, _ in L.DIRECT_KO}
        elements = sum((v.cast("int") for v in own.values()), F.lit(0))
        out = [(h[f"h{i}"] > 0, n, F.when(h[f"h{i}"] >= 2, "high").otherwise("medium")) for i, (n, _) in enumerate(L.POSTURE_KO)]
        out.append((own["tort_basis"] & own["conduct"] & own["harm"] & (elements >= 4), "direct_tort_claim", F.when(elements == 5, "high").otherwise("medium")))
        posture, sure = first_with_level(out)
        contract = h[f"h{[n for n, _ in L.POSTURE_KO].index('contract_or_payment')}"] > 0
        basis = first_of([((posture == "direct_tort_claim") & contract, "mixed_tort_contract"), (posture == "direct_tort_claim", "non_contractual_tort"), *_basis(posture, L.BASIS_KO)], "unclear")
        return F.struct(posture.alias("posture"), sure.alias("confidence"), basis.alias("basis"))

    return let(hits, judged)


def subtype_ko(x: Column | str) -> Column:
    """First kind of tort with a hit (CLS-6)."""
    return first_of([(_some(_text(x), p), n) for n, p in L.SUBTYPE_KO], "unclear")


def harms(x: Column | str, table=L.HARM_KO) -> Column:
    """struct of the flags of harm (CLS-6, CLS-9)."""
    return F.struct(*[_text(x).rlike("(?i)" + p).alias(n) for n, p in table])


def posture_en(name: Column | str, metadata: Column | str, x: Column | str) -> Column:
    """struct(posture, confidence, basis) of an English claim (CLS-7). Excluding postures come first; a sole sign of
    insurance coverage does not displace a clearly pleaded direct claim."""
    own = _text(x, 30000)
    t = F.concat_ws("\n", _text(name), _text(metadata), own)
    groups = {"tort": L.TORT_EN, "conduct": L.CONDUCT_EN, "harm": L.HARM_EN, "cause": L.CAUSATION_EN, "plaintiff": L.PLAINTIFF_EN}
    counted = {"contract": L.CONTRACT_EN, "rights": L.CIVIL_RIGHTS_EN, "procedure": L.PROCEDURAL_EN}
    found = {f"h{i}": F.size(evidence(t, p, 160)) for i, (_, p) in enumerate(L.POSTURE_EN)} | {n: evidence(t, p, 160) for n, p in groups.items()}
    found |= {n: F.size(evidence(t, p, 160)) for n, p in counted.items()} | {"mixed": F.size(evidence(own, L.CONTRACT_BASIS_EN, 160)) >= 2}

    def judged(h: Column) -> Column:
        has = {n: F.size(h[n]) > 0 for n in groups}
        direct = sum((has[n].cast("int") for n in ("tort", "conduct", "harm", "plaintiff")), F.lit(0))
        every = F.size(F.array_distinct(F.concat(*[h[n] for n in groups])))
        level = lambda k: F.when(k >= 2, "high").otherwise("medium")
        out = [((h[f"h{i}"] > 0) & ~((direct >= 4) & (h[f"h{i}"] < 2)) if n == "insurance_coverage" else h[f"h{i}"] > 0, n, level(h[f"h{i}"])) for i, (n, _) in enumerate(L.POSTURE_EN)]
        out += [
            ((direct >= 4) & (has["cause"] | (F.size(h["tort"]) >= 2)), "direct_tort_claim", F.when(has["cause"] & (every >= 6), "high").otherwise("medium")),
            ((h["contract"] > 0) & ~(has["conduct"] & has["harm"] & has["plaintiff"]), "contract_or_payment", level(h["contract"])),
            ((h["rights"] > 0) & ~has["tort"], "civil_rights_only", F.lit("medium")),
            ((h["procedure"] > 0) & ~(has["conduct"] & has["harm"]), "procedural_only", F.lit("medium")),
        ]
        posture, sure = first_with_level(out)
        basis = first_of([((posture == "direct_tort_claim") & h["mixed"], "mixed_tort_contract"), (posture == "direct_tort_claim", "non_contractual_tort"), *_basis(posture, L.BASIS_EN)], "unclear")
        return F.struct(posture.alias("posture"), sure.alias("confidence"), basis.alias("basis"))

    return let(found, judged)


def stage_en(x: Column | str) -> Column:
    """struct(stage, fact_status) of an English opinion (CLS-8)."""
    t = _text(x, 30000)
    dotall = lambda ps: [f"(?s){p}" for p in ps]
    stage = first_of([(_some(t, dotall(p)), n) for n, p in L.STAGES_EN], "unknown")
    status = first_of([*[(_some(t, dotall(p)), n) for n, p in L.FACT_STATUS_EN], (stage == "demurrer_or_motion_to_dismiss", "assumed_true_for_pleading")], "unclear")
    return F.struct(stage.alias("stage"), status.alias("fact_status"))


def subtype_en(x: Column | str) -> Column:
    """Kind of tort by three points a pattern and two for a specific kind; earlier kinds win ties (CLS-9)."""
    t = _text(x, 30000)
    scored = [F.struct((matching(t, p) * 3 + F.when(_some(t, p), 0 if n in L.GENERIC_EN else 2).otherwise(0)).alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, p) in enumerate(L.SUBTYPE_EN)]
    best = F.greatest(*scored)
    return F.when(best["s"] > 0, best["n"]).otherwise("unclear")


def court_ko(x: Column | str, court: Column | str, number: Column | str, code: Column | str) -> Column:
    """struct(level, confidence, n_signs) of a Korean opinion by its name, its verified number's code and signs of an
    appeal (CLS-10, older form)."""
    t, name, own = _text(x, 5000), _text(court), F.coalesce(col(code), F.lit(""))
    verified = F.coalesce(col(number), F.lit("")) != ""
    signs, supreme = matching(t, [p for _, p in L.APPEAL_SIGNS_KO]), _some(t, [p for _, p in L.SUPREME_SIGNS_KO])
    by_court, by_number = name.contains("고등법원") | name.rlike("지방법원.*항소부"), verified & (own == "나")
    top = name.contains("대법원") | (verified & (own == "다") & (signs == 0))
    sure = first_of([(by_court & by_number & ~supreme, "high"), ((signs >= 3) & ~supreme, "high"), (signs >= 2, "medium"), ((by_court | by_number) & (signs >= 1), "medium")], "low")
    level = first_of([(top, "supreme"), (sure != "low", "appellate"), (verified & own.isin("가합", "가단", "가소"), "trial")], "unknown")
    return F.struct(level.alias("level"), F.when(top, "high").otherwise(sure).alias("confidence"), signs.alias("n_signs"))


def court_ca(name: Column | str, jurisdiction: Column | str, kind: Column | str) -> Column:
    """struct(system, level, confidence) of a court of California (CLS-11)."""
    n, j = squeeze(name), squeeze(jurisdiction)
    both = F.concat_ws("\n", n, j)
    appeal, other = matching(n, L.APPEAL_COURTS_CA), _some(both, L.OTHER_COURTS_CA)
    meta = F.lower(j).isin("california", "california, ca", "ca").cast("int") + (F.upper(squeeze(kind)) == "SA").cast("int")
    here = j.rlike("(?i)California(?:, CA)?") | n.rlike(r"(?i)California|Cal\. Ct\.")
    state = here & ~both.rlike("(?i)United States|Federal|Ninth Circuit|District Court")
    is_appeal = (appeal > 0) & ~other
    sure = first_of([(is_appeal & (meta > 0), "high"), (is_appeal & (appeal + meta >= 2), "medium")], "low")
    return F.struct(F.when(state, "california_state").otherwise("other").alias("system"), F.when(is_appeal, "intermediate_appellate").otherwise("other").alias("level"), sure.alias("confidence"))


def district(metadata: Column | str, x: Column | str) -> Column:
    """struct(district, division) by a docket suffix or in words (CLS-11)."""
    t = F.concat_ws("\n", _text(metadata, 4000), _text(x, 1500))
    first = F.regexp_extract(t, r"(?i)\bCA([1-6])/(\d+)\b", 1)
    number = F.when(first != "", F.element_at(F.array(*map(F.lit, L.ORDINALS)), F.greatest(first.try_cast("int"), F.lit(1))))
    words = lambda p: F.initcap(F.nullif(F.regexp_extract(t, "(?i)" + p, 0), F.lit("")))
    by_words = words(r"\b(?:" + "|".join(L.ORDINALS) + r") Appellate District\b")
    part = words(r"\bDivision\s+(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine|\d+)\b")
    return F.struct(
        F.when(first != "", F.concat(number, F.lit(" Appellate District"))).otherwise(by_words).alias("district"),
        F.when(first != "", F.concat(F.lit("Division "), F.regexp_extract(t, r"(?i)\bCA([1-6])/(\d+)\b", 2))).otherwise(part).alias("division"),
    )


def publication(x: Column | str) -> Column:
    """Whether an opinion is published (CLS-11)."""
    raw = F.lower(squeeze(x))
    return first_of([((raw == "precedential") | (raw.contains("published") & ~raw.contains("unpublished")), "published"), (raw.rlike("unpublished|non-precedential|nonprecedential"), "unpublished")], "unknown")


def civil(name: Column | str, x: Column | str, posture: Column) -> Column:
    """Whether a case is civil: a direct claim, or no sign of a criminal one (CLS-11)."""
    sample = F.concat_ws("\n", _text(name), _text(x, 15000))
    return (posture == "direct_tort_claim") | ~_some(sample, L.CRIMINAL_EN)


def governing_law(x: Column | str, system: Column, court_confidence: Column, posture: Column) -> Column:
    """struct(law, confidence, federal, other_state) (CLS-11)."""
    t = _text(x, 30000)
    other, own = _some(t, L.OTHER_LAW_EN), _some(t, L.CALIFORNIA_LAW_EN)
    core = (system == "california_state") & (posture != "civil_rights_only") & ~other
    sure = first_of([(core & (own | (court_confidence == "high")), "high"), (core, "medium")], "low")
    return F.struct(F.when(core, "california_state_law").otherwise("federal_or_other_law").alias("law"), sure.alias("confidence"), _some(t, L.FEDERAL_LAW_EN).alias("federal"), other.alias("other_state"))


def other_civil(domain: Column | str, *parts: Column | str) -> Column:
    """Kind of a case of other civil liability; null for other domains (CLS-12)."""
    t = F.lower(F.concat_ws(" ", *[_text(p) for p in parts]))
    return F.when(col(domain) == "other_civil_liability", first_of([(t.rlike(p), n) for n, p in L.OTHER_CIVIL], "other_economic_or_personal"))


def note_code(note: Column | str) -> Column:
    """Code of a reviewer's note (CLS-13)."""
    t = F.lower(_text(note))
    return first_of([(t.contains(p), n) for p, n in L.NOTE_CODES], "other_non_merits_proceeding")


def facts_ko(x: Column | str) -> Column:
    """struct(score, quality, independent, missing) of a Korean opinion's facts (FCT-2)."""
    t = _text(x)
    probe = F.substring(t, 1, 12000)
    has = {n: _some(probe, p) for n, p in L.FACTS_KO}
    n = sum((v.cast("int") for v in has.values()), F.lit(0))
    section = F.length(F.regexp_extract(t, L.FACT_SECTION_KO, 1))
    score = F.least(F.lit(100), n * 13 + F.when(section >= 500, 9).otherwise(0))
    taken = _some(t, L.INCORPORATED_KO)
    enough = (n >= 6) & (score >= 78)
    whole = (section >= 180) | ((F.length(t) >= 500) & (n == len(L.FACTS_KO)))
    quality = first_of([(taken & (section < 500), "mostly_incorporated"), (taken, "partially_incorporated"), (whole & enough, "self_contained")], "insufficient")
    alone = ((quality == "partially_incorporated") & enough) | (quality == "self_contained")
    missing = F.array_compact(F.array(*[F.when(~v, k) for k, v in has.items()]))
    return F.struct(score.alias("score"), quality.alias("quality"), alone.alias("independent"), missing.alias("missing"))


def facts_en(x: Column | str, whole: Column) -> Column:
    """struct(score, quality, sufficient, reasons) of an English opinion's facts; whole: its main opinion is there (FCT-2)."""
    t = _text(x, 50000)
    dotall = lambda p: f"(?s){p}"
    has = {n: _some(t, [dotall(p) for p in ps]) for n, ps in L.FACTS_EN}
    heading = t.rlike(L.FACT_HEADING_EN)
    score = F.least(F.lit(100), sum((v.cast("int") for v in has.values()), F.lit(0)) * 12 + F.when(heading, 8).otherwise(0) + F.when(F.length(t) >= 5000, 8).otherwise(0))
    count = lambda p: F.regexp_count(t, F.lit("(?i)" + p))
    facts = sum((count(p) for _, ps in L.FACTS_EN for p in ps), F.lit(0))
    required = sorted(n for n, _ in L.FACTS_EN if n != "defense_or_dispute")
    reasons = [
        (~whole, "full_main_opinion_unavailable"),
        *[(~has[n], f"missing_{n}") for n in required],
        (~has["defense_or_dispute"], "missing_defense_or_disputed_facts"),
        ((count(L.PROCEDURE_TERMS_EN) > F.greatest(F.lit(30), facts * 4)) & ~heading, "procedural_or_legal_discussion_dominates"),
    ]
    enough = whole & (score >= 80)
    for v in has.values():
        enough = enough & v
    quality = first_of([(enough & heading, "self_contained"), (enough, "partially_incorporated")], "insufficient")
    return F.struct(score.alias("score"), quality.alias("quality"), enough.alias("sufficient"), F.array_compact(F.array(*[F.when(c, n) for c, n in reasons])).alias("reasons"))


def residue(x: Column | str, language: str) -> Column:
    """Sorted words of the other language once placeholders and metric units are out (STR-20)."""
    t = F.regexp_replace(F.regexp_replace(_text(x), r"\[[A-Z_]+\]", " "), r"(?i)\b(?:km/h|km|kg|m|°c)\b", " ")
    if language != "ko":
        return F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit("[가-힣]{2,}"), F.lit(0))))
    words = F.regexp_extract_all(t, F.lit("(?<![A-Za-z])[A-Za-z]{3,}(?![A-Za-z])"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != F.upper(w)) | (F.length(w) > 5))))


def anchors(x: Column | str) -> Column:
    """Names of what happened and of who knew that a text states (BIL-3)."""
    t = F.lower(_text(x))
    any_ = lambda terms: t.rlike("|".join(terms))
    knew = F.when(any_(L.KNEW_NOT), "knowledge_negative").when(any_(L.KNEW), "knowledge_positive")
    return F.array_compact(F.array(*[F.when(any_(terms), n) for n, terms in L.ANCHORS], knew))


def translated_fact(source: Column | str, target: Column | str, source_language: str) -> Column:
    """struct(errors, warnings) of one translated fact: placeholders, numbers, units, anchors and polarity (BIL-3)."""
    s, t = _text(source), _text(target)
    target_language = "en" if source_language == "ko" else "ko"
    a, b = anchors(s), anchors(t)
    events = lambda x: F.filter(x, lambda v: ~v.startswith("knowledge"))
    turned = (F.array_contains(a, "knowledge_positive") & F.array_contains(b, "knowledge_negative")) | (F.array_contains(a, "knowledge_negative") & F.array_contains(b, "knowledge_positive"))
    denies = lambda x, lang: F.concat(F.lit(" "), F.lower(x), F.lit(" ")).rlike("|".join(L.NEGATIONS[lang]))
    equal = (s.contains("다툼이 없") & F.lower(t).contains("undisputed")) | (F.lower(s).contains("undisputed") & t.contains("다툼이 없"))
    own, other = numbers(s), numbers(t)
    errors = [
        (~same_set(placeholders(s), placeholders(t)), "placeholder_identity_mismatch"),
        (~same_set(own, other), "numerical_value_changed"),
        (~same_set(units(s), units(t)), "measurement_value_changed"),
        (~same_set(a, b) & (F.size(F.concat(events(a), events(b))) > 0), "independent_fact_added_or_omitted"),
        (turned, "clear_polarity_reversal"),
    ]
    warnings = [
        (same_set(own, other) & ~same_multiset(own, other), "number_occurrence_count_differs"),
        (F.size(residue(t, target_language)) > 0, "target_language_residue"),
        ((denies(s, source_language) != denies(t, target_language)) & ~equal, "lexical_negation_mismatch_requires_verifier"),
    ]
    named = lambda pairs: F.array_compact(F.array(*[F.when(c, n) for c, n in pairs]))
    return F.struct(named(errors).alias("errors"), named(warnings).alias("warnings"))


def grounded_units(units_: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units joined with the passage they name: span, start and end become the passage's, and an unknown passage or one of
    the other court level fails (GRD-2). units: key, fact_id, level, span_id, span; passages: key, span_id, text, start,
    end; spans of the highest court have ids H.., others L.. ."""
    there = passages.select(key, "span_id", F.col("text").alias("__text"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    j = units_.join(there, [key, "span_id"], "left")
    prefix = F.when(F.col("level") == "highest_court", "H").otherwise("L")
    ok = F.col("__text").isNotNull() & F.coalesce(F.col("span_id").startswith(prefix), F.lit(False))
    copied = F.when(F.col("span") == F.col("__text"), "exact").otherwise("canonicalized_from_source_span_id")
    return j.select(
        key, "fact_id", "span_id", F.when(ok, "pass").otherwise("fail").alias("status"), F.when(ok, copied).alias("copy_status"),
        F.when(ok, F.col("__text")).otherwise(F.col("span")).alias("span"), F.when(ok, F.col("__start")).alias("start"), F.when(ok, F.col("__end")).alias("end"),
    )
