"""Rule-based classifiers and quality checks, as Column expressions over whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.scalars import date_text, density, same_multiset, same_set
from ..functions.text import col, context, grounding_form, hits, replaced, sentences, sha, squeeze, term_count
from .rows import first_of


def _flag(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def _head(x: Column | str, n: int) -> Column:
    return F.substring(F.coalesce(col(x), F.lit("")), 1, n)


def _named(pairs: list[tuple[str, Column]]) -> Column:
    """Names whose test holds, in order."""
    return F.array_compact(F.array(*[F.when(test, name) for name, test in pairs]))


def domain(text: Column | str) -> Column:
    """struct(domain, score, confidence, evidence, tags) by weighted hits, five a domain at most (CLS-1)."""
    sample = _head(text, 60000)
    scores = [F.least(F.regexp_count(sample, F.lit(p)), F.lit(5)) * w for _, w, p in X.DOMAINS]
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("name"), hits(F.substring(sample, 1, 60000), p, 8).alias("evidence")) for i, (s, (n, _, p)) in enumerate(zip(scores, X.DOMAINS, strict=True))]))
    first, second = -ranked[0]["s"], -ranked[1]["s"]
    none = first == 0
    sure = F.when((first >= 3) & (first >= second + 2), "high").when(first >= 2, "medium").otherwise("low")
    tags = _named([(n, _flag(sample, p)) for n, p in X.TAGS])
    return F.struct(
        F.when(none, X.DOMAINS[-1][0]).otherwise(ranked[0]["name"]).alias("domain"),
        first.cast("long").alias("score"),
        sure.alias("confidence"),
        ranked[0]["evidence"].alias("evidence"),
        F.when(none, F.array().cast("array<string>")).otherwise(tags).alias("tags"),
    )


def liability(text: Column | str) -> Column:
    """struct(candidate, include, exclusions): some core term and no fatal exclusion (CLS-3)."""
    include = hits(_head(text, 70000), X.CORE_LIABILITY, 12)
    found = _named([(n, _flag(_head(text, 30000), p)) for n, p in X.EXCLUSIONS])
    fatal = F.arrays_overlap(found, F.array(*map(F.lit, X.FATAL)))
    return F.struct(((F.size(include) > 0) & ~fatal).alias("candidate"), include.alias("include"), found.alias("exclusions"))


def case_number(text: Column | str, structured: Column | str) -> Column:
    """struct(number, code, evidence) from metadata, else from a labelled header (CLS-4)."""
    given = squeeze(structured)
    label = F.regexp_extract(_head(text, 3000), X.LABELLED_CASE_NUMBER, 1)
    source = F.when(given.rlike(X.CASE_NUMBER), given).when(label.rlike(X.CASE_NUMBER), label)
    evidence = F.when(given.rlike(X.CASE_NUMBER), "structured_metadata").when(label.rlike(X.CASE_NUMBER), "labelled_header")
    return F.struct(squeeze(F.regexp_extract(source, X.CASE_NUMBER, 0)).alias("number"), F.regexp_extract(source, X.CASE_NUMBER, 2).alias("code"), evidence.alias("evidence"))


def court(text: Column | str, structured_court: Column | str, structured_number: Column | str) -> Column:
    """struct(level, confidence, evidence): the highest court by two independent signs (CLS-4, CLS-10)."""
    head, name, case = _head(text, 5000), squeeze(structured_court), case_number(text, structured_number)
    known = case["evidence"].isNotNull()
    by_name = (name == "대법원") | name.contains("대한민국 대법원")
    by_header = _flag(head, X.SUPREME_HEADER)
    by_code = F.coalesce(known & case["code"].isin(*X.SUPREME_CODES), F.lit(False))
    disposed, reasoned = _flag(head, X.SUPREME_DISPOSITION), _flag(head, X.SUPREME_REASONING)
    lower_name = (name != "") & first_of([(name.contains(c), "y") for c in X.LOWER_COURTS]).isNotNull()
    lower_code = F.coalesce(known & case["code"].isin(*X.LOWER_CODES), F.lit(False))
    signs = _named([("structured_court", by_name), ("explicit_supreme_header", by_header), ("current_case_code", by_code), ("supreme_disposition", disposed), ("supreme_reasoning_marker", reasoned)])
    high = (by_name | by_header | by_code) & (F.size(signs) >= 2)
    level = F.when(lower_name | lower_code, "lower").when(high | (disposed & reasoned), "supreme").otherwise("unknown")
    sure = F.when(lower_name | lower_code | high, "high").when(disposed & reasoned, "medium").otherwise("low")
    lower = _named([("structured_lower_court", lower_name), ("current_lower_code", lower_code)])
    return F.struct(level.alias("level"), sure.alias("confidence"), F.concat(signs, lower).alias("evidence"))


def decision_date(text: Column | str, structured: Column | str) -> Column:
    """Date of the metadata, else of the decision header (DAT-3)."""
    return F.coalesce(date_text(structured), date_text(F.regexp_extract(_head(text, 3000), X.DECISION_HEADER, 1)))


def opinion_type(value: Column | str, per_curiam: Column | bool = False) -> Column:
    """Kind of an opinion (CLS-5)."""
    raw = F.regexp_replace(F.lower(squeeze(value)), "[^a-z0-9]", "")
    exact = [(raw == k, v) for k, v in X.OPINION_TYPES]
    parts = [(raw.contains(k), v) for k, v in X.OPINION_PARTS]
    own = F.lit(per_curiam) if isinstance(per_curiam, bool) else F.coalesce(per_curiam, F.lit(False))
    return first_of([(own, "on_the_merits"), *exact, *parts], "unknown")


def main_opinion(opinions: Column, least: int = 1200) -> Column:
    """struct(text, kind, id, usable, has_concurrence, has_dissent) of an array of struct(opinion_id, type, per_curiam,
    opinion_text): by kind, then the longest, then kind, text and id (SRT-2)."""
    typed = F.transform(F.coalesce(opinions, F.array()), lambda o: F.struct(opinion_type(o["type"], o["per_curiam"]).alias("kind"), squeeze(o["opinion_text"]).alias("text"), squeeze(o["opinion_id"]).alias("id")))
    own = F.filter(typed, lambda o: ~o["kind"].isin("concurrence", "dissent") & (o["text"] != ""))

    def ranked(o: Column) -> Column:
        rank = first_of([(o["kind"] == k, str(v)) for k, v in X.OPINION_RANK.items()], "9").cast("int")
        return F.struct(rank.alias("rank"), (-F.length(o["text"])).alias("n"), o["kind"].alias("kind"), o["text"].alias("text"), o["id"].alias("id"))

    best = F.try_element_at(F.array_sort(F.transform(own, ranked)), F.lit(1))
    usable = F.coalesce((F.length(best["text"]) >= least) & ~best["kind"].isin("plurality", "unknown"), F.lit(False))
    return F.struct(
        F.coalesce(best["text"], F.lit("")).alias("text"), F.coalesce(best["kind"], F.lit("unknown")).alias("kind"), best["id"].alias("id"), usable.alias("usable"),
        F.exists(typed, lambda o: o["kind"] == "concurrence").alias("has_concurrence"), F.exists(typed, lambda o: o["kind"] == "dissent").alias("has_dissent"),
    )


def state_highcourt(court_type: Column | str, jurisdiction: Column | str, name: Column | str) -> Column:
    """Whether a court is a state's highest one: type S and no federal name (CLS-5)."""
    return (F.upper(squeeze(court_type)) == "S") & ~F.concat_ws(" ", squeeze(jurisdiction), squeeze(name)).rlike(X.FEDERAL)


def state(jurisdiction: Column | str) -> Column:
    """Full name of the state that a jurisdiction names (CLS-5, JOI-12)."""
    raw = F.lower(squeeze(jurisdiction))
    return first_of([(raw.isin(s.lower(), a.lower()) | raw.startswith(s.lower() + ","), s) for s, a in X.STATES])


def facts(text: Column | str) -> Column:
    """struct(score, missing, core, preferred) of the seven dimensions of facts (FCT-1)."""
    sample = _head(text, 80000)
    has = {n: _flag(sample, p) for n, p in X.FACTS}
    score = sum((v.cast("int") for v in has.values()), F.lit(0))
    missing = _named([(n, ~has[n]) for n in X.MANDATORY_FACTS])
    core = F.size(missing) == 0
    return F.struct(score.alias("score"), missing.alias("missing"), core.alias("core"), (core & (score >= 5)).alias("preferred"), *[v.alias(n) for n, v in has.items()])


def grounding(source: Column | str, span: Column | str) -> Column:
    """struct(status, start, end): the span itself, else with any white space, else in normal form (GRD-1)."""
    s, t = F.coalesce(col(source), F.lit("")), F.coalesce(col(span), F.lit(""))
    place = F.call_function("instr", s, t)
    words = F.filter(F.split(squeeze(t), " "), lambda w: w != "")
    loose = F.concat(F.lit("(?i)"), F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([\\\[\](){}.*+?^$|])", r"\\$1")), r"\s+"))
    found = F.regexp_instr(s, loose)
    size = F.length(F.regexp_substr(s, loose))
    normal = F.contains(grounding_form(s), grounding_form(t))
    blank = squeeze(t) == ""
    status = F.when(blank, "fail").when((place > 0) | (found > 0) | normal, "pass").otherwise("fail")
    start = F.when(blank, None).when(place > 0, place - 1).when(found > 0, found - 1)
    end = F.when(blank, None).when(place > 0, place - 1 + F.length(t)).when(found > 0, found - 1 + size)
    return F.struct(status.alias("status"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def state_abbreviations(text: Column | str) -> Column:
    """State abbreviations as words; CT before or after a scan's words is none (LEK-1)."""
    names = "|".join(sorted(a for _, a in X.STATES if a != "CT"))
    scan = r"(?<!(?i:brain)\s{0,9})(?<!뇌\s{0,9})\bCT\b(?!\s+(?i:scan|촬영|검사)\b)"
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(rf"\b(?:{names})\b|{scan}"), F.lit(0))


def jurisdiction_pattern() -> str:
    names = "|".join(sorted((s for s, _ in X.STATES), key=lambda s: (-len(s), s)))
    return rf"(?i){X.COUNTRY_WORDS}|(?<![A-Za-z])(?:{X.COUNTRY_NAMES}|{names})(?![A-Za-z])"


def leakage(text: Column | str) -> Column:
    """struct(legal, jurisdiction, strict statuses and evidence) (LEK-1, LEK-2)."""
    t = F.coalesce(col(text), F.lit(""))
    legal = F.array_distinct(F.concat(hits(t, X.LEGAL_KO, 1000), hits(t, X.LEGAL_EN, 1000)))
    where = F.array_distinct(F.concat(hits(t, jurisdiction_pattern(), 1000), state_abbreviations(t)))
    strict = {n: hits(t, p, 1000) for n, p in X.STRICT}
    status = lambda *a: F.when(sum((F.size(x) for x in a), F.lit(0)) > 0, "fail").otherwise("pass")
    place = [strict[n] for n in ("customary_unit", "currency", "kr_institution", "jurisdiction_placeholder")]
    return F.struct(
        status(legal).alias("legal"), status(where).alias("jurisdiction"), status(strict["procedural"]).alias("strict_procedural"), status(legal, strict["legal_conclusion"]).alias("strict_legal"),
        status(where, *place).alias("strict_jurisdiction"), legal.alias("legal_evidence"), where.alias("jurisdiction_evidence"), F.struct(*[v.alias(n) for n, v in strict.items()]).alias("evidence"),
    )


def neutralised(text: Column | str) -> Column:
    """Text with names of groups, countries and states as placeholders (STR-12)."""
    names = "|".join(sorted(a for _, a in X.STATES if a != "CT"))
    return replaced(text, [(X.GROUP_IDENTITY, "[GROUP_A]"), (rf"\b(?:{names})\b", "[LOCATION_JURISDICTION]"), (jurisdiction_pattern(), "[LOCATION_JURISDICTION]")])


def without_citations(text: Column | str) -> Column:
    """Text without citation strings, squeezed (STR-11)."""
    return squeeze(replaced(text, [(p, " ") for p in X.CITATIONS]))


def placeholders(text: Column | str) -> Column:
    return F.sort_array(hits(text, X.PLACEHOLDER, 10000))


def numbers(text: Column | str) -> Column:
    """Sorted multiset of numbers: digits, English words, ordinals and months, Korean counters; `and six others` is seven
    (NUM-1). Built-in expressions only."""
    t = F.coalesce(col(text), F.lit(""))
    every = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    word_map = F.create_map(*[F.lit(x) for pair in X.NUMBER_WORDS for x in pair])
    pattern = r"(?i)\b(?:" + "|".join(w for w, _ in X.NUMBER_WORDS) + r")\b"
    from_words = F.transform(every(pattern), lambda w: F.element_at(word_map, F.lower(w)))
    months = [F.array_repeat(F.lit(str(i + 1)), F.regexp_count(t, F.lit(rf"\b{m}\b"))) for i, m in enumerate(X.MONTHS)]
    one = F.regexp_count(t, F.lit(X.KOREAN_ONE))
    counted = [F.array_repeat(F.lit(v), F.regexp_count(t, F.lit(p))) for v, p in X.KOREAN_COUNTERS]
    # the older counter of one and the newer one name the same thing: the older is taken back where the newer is there
    base = F.concat(every(X.NUMBER), from_words, *months, *counted, F.when(F.size(counted[0]) > 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit("1"), one)))
    others = F.transform(F.regexp_extract_all(t, F.lit(X.OTHERS), F.lit(1)), lambda w: F.element_at(word_map, F.lower(w)))

    def one_more(values: Column, v: Column) -> Column:
        at = F.array_position(values, v).cast("int")
        kept = F.when(at > 0, F.concat(F.slice(values, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(values, F.greatest(at + 1, F.lit(1)), F.size(values)))).otherwise(values)
        return F.concat(kept, F.array((v.cast("int") + 1).cast("string")))

    return F.sort_array(F.aggregate(others, base, one_more))


def units(text: Column | str) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    return F.concat(*[F.array_repeat(F.lit(u), F.regexp_count(t, F.lit(p))) for u, p in X.UNITS])


def equivalence(source: Column | str, target: Column | str, language: Column | str) -> Column:
    """struct(status, issues, warnings): placeholders must agree; numbers, units and negation warn (BIL-1)."""
    s, t, ko = F.coalesce(col(source), F.lit("")), F.coalesce(col(target), F.lit("")), col(language) == "ko"
    denies = lambda x, korean: F.when(korean, x.rlike(X.NEGATION["ko"])).otherwise(x.rlike(X.NEGATION["en"]))
    issues = _named([("placeholder_mismatch", ~same_set(placeholders(s), placeholders(t)))])
    warnings = _named([("number_mismatch", ~same_multiset(numbers(s), numbers(t))), ("unit_mismatch", ~same_multiset(units(s), units(t))), ("negation_presence_mismatch", denies(s, ko) != denies(t, ~ko))])
    return F.struct(F.when(F.size(issues) == 0, "pass").otherwise("fail").alias("status"), issues.alias("issues"), warnings.alias("warnings"))


def language_sanity(text: Column | str, expected: str) -> Column:
    """pass if enough letters are of the expected script (STR-19)."""
    t = F.coalesce(col(text), F.lit(""))
    hangul, latin = F.regexp_count(t, F.lit("[가-힣]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    own, least, share = (hangul, 10, 0.35) if expected == "ko" else (latin, 20, 0.70)
    return F.when((own >= least) & (own / F.greatest(hangul + latin, F.lit(1)) >= share), "pass").otherwise("fail")


def repeated_sentences(text: Column | str) -> Column:
    """Sentences of 15 characters or more that stand more than once, sorted (DED-11): neighbours that are equal in order."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"(?<=[.!?])\s+(?!\d)|\n+"), lambda s: F.lower(squeeze(s)))
    sorted_ = F.array_sort(F.filter(parts, lambda s: F.length(s) >= 15))
    again = F.zip_with(sorted_, F.slice(sorted_, 2, F.greatest(F.size(sorted_) - 1, F.lit(0))), lambda x, y: F.when(x == y, x))
    return F.array_distinct(F.array_compact(again))


def bilingual(ko: Column | str, en: Column | str, language: Column | str) -> Column:
    """struct of the deterministic checks of a pair (BIL-2)."""
    a, b = leakage(ko), leakage(en)
    ok = lambda test: F.when(test, "pass").otherwise("fail")
    both = lambda f: ok((a[f] == "pass") & (b[f] == "pass"))
    return F.struct(
        ok((language_sanity(ko, "ko") == "pass") & (language_sanity(en, "en") == "pass")).alias("language"),
        ok(same_set(placeholders(ko), placeholders(en))).alias("placeholders"),
        ok((F.size(repeated_sentences(ko)) == 0) & (F.size(repeated_sentences(en)) == 0)).alias("duplicates"),
        both("strict_legal").alias("legal"), both("strict_procedural").alias("procedural"), both("strict_jurisdiction").alias("jurisdiction"),
        ok(same_multiset(numbers(ko), numbers(en))).alias("numbers"), equivalence(F.when(col(language) == "ko", col(ko)).otherwise(col(en)), F.when(col(language) == "ko", col(en)).otherwise(col(ko)), language).alias("equivalence"),
    )


def out_of_scope(text: Column | str) -> Column:
    """First signal of a source that does not belong (FLT-10)."""
    return first_of([(_flag(col(text), p), n) for n, p in X.SOURCE_SIGNALS])


def label_guard(label: Column | str, text: Column | str) -> Column:
    """Why a label is in doubt (FLT-11)."""
    t, own = F.coalesce(col(text), F.lit("")), col(label)
    return first_of([
        ((own == "product_liability") & t.rlike(X.PATENT) & ~t.rlike(X.DEFECT), "patent_or_royalty_without_product_defect"),
        ((own == "medical_professional_liability") & t.rlike(X.INCIDENTAL) & ~t.rlike(X.TREATMENT), "incidental_medical_reference_without_malpractice"),
    ])


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lexical and structural features of each document (FEA-1)."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size(F.regexp_extract_all(t, F.lit(X.TOKEN), F.lit(0)))
    s = F.greatest(F.size(sentences(t, 1)), F.lit(1))
    low = F.lower(t)
    terms = {k: term_count(low, [w.lower() for w in v]) for k, v in (("doctrine", X.DOCTRINE), ("remedy", X.REMEDY), ("procedure", X.PROCEDURE), ("jurisdiction", X.JURISDICTION))}
    return docs.select(
        "doc_id", n.cast("long").alias("n_tokens"), s.cast("long").alias("n_sentences"), F.bround(n / s, 4).alias("avg_sentence"),
        *[v.alias(f"{k}_terms") for k, v in terms.items()], *[density(v, n).alias(f"{k}_per_1k") for k, v in terms.items()],
    )


def family_id(citation: Column | str, source: Column | str, text_hash: Column | str) -> Column:
    """Family by citation, else by source and hash (DED-2)."""
    c = squeeze(citation)
    other = F.concat_ws("\x1f", squeeze(source), F.coalesce(col(text_hash), F.lit("")))
    return F.concat(F.lit("FAM_"), F.when(c != "", sha(F.lower(c), 16)).otherwise(sha(other, 16)))


def date_role(text: Column | str, pattern: str, roles: list[tuple[str, str]], radius: int = 30) -> Column:
    """Role of the first date by the words around it (DAT-4)."""
    near = context(text, pattern, radius)
    return first_of([(near.rlike(p), r) for r, p in roles], "unknown")
