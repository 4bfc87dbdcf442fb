"""Queries of the older label sets. The documents' texts get phrases of the field by their id, so that every label occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_labels as L
from ..operators import labels
from .registry import query

ENGLISH = (
    "The plaintiff sued the defendant for negligence after a car accident; the driver caused personal injury.", "A duty to defend and insurance coverage were at issue.", "The insurer as subrogee paid and sought reimbursement; subrogation followed.",
    "He sued for breach of contract under a purchase agreement.", "They sought declaratory relief that it was not liable.", "Claims under section 1983 and other constitutional violation.", "The special motion to strike raised appealability.",
    "Unpaid wages and overtime pay were claimed.", "A writ of execution against the judgment debtor issued.", "Quiet title and foreclosure of the deed of trust.", "Child custody after dissolution of marriage.", "An agency decision by the Public Utilities Commission.",
    "The jury found that the surgeon failed to diagnose; medical malpractice caused death and emotional distress.", "The demurrer was sustained, facts accepted as true.", "Summary judgment on undisputed facts of a slip and fall.", "Nothing more.",
    "The defendant argued comparative negligence; the accident in 2010 resulted in medical expenses after the collision between plaintiff and defendant.", "The trial court found a design defect and strict liability.",
)
KOREAN = (
    "피고의 불법행위로 인한 교통사고로 원고가 상해를 입어 피해자에게 치료비 손해가 발생하였다.", "청구이의와 강제집행 불허를 구한다.", "미지급 임금 및 퇴직금을 청구한다.", "보험자대위에 의한 구상금 청구이다.", "보험약관의 면책사유가 문제된다.", "이혼과 양육비에 관한 사건이다.",
    "국가배상 청구이다.", "소유권이전등기 절차를 이행하라.", "대여금과 매매대금의 지급을 구한다.", "관할위반으로 이송결정을 하였다.", "제조물책임과 제품의 결함이 문제된다.", "명예훼손으로 인한 위자료를 구한다.", "아무 내용이 없다.",
    "기초사실 원고와 피고는 사고 당시 도로에서 2010. 3. 4. 충돌하였고 그 결과 원고가 사망하였다. 피고는 책임이 없다고 주장한다. 판단",
    "제1심판결의 해당 부분을 그대로 인용한다. 항소를 모두 기각한다. 항소비용은 원고의 항소로 인한 것이다.", "상고이유를 살핀다.",
)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _with(phrases: tuple[str, ...], cut: int | None = None) -> str:
    values = "[" + ", ".join(map(_quoted, phrases)) + "]"
    n = len(phrases)
    whole = f"coalesce(text, '') || ' ' || {values}[doc_id % {n} + 1] || ' ' || {values}[doc_id // {n} % {n} + 1]"
    return f"(SELECT doc_id, {f'substr({whole}, 1, {cut})' if cut else whole} AS x FROM documents)"


def _phrased(t, phrases: tuple[str, ...]):
    values, n = F.array(*map(F.lit, phrases)), len(phrases)
    pick = lambda k: F.element_at(values, (k % n + 1).cast("int"))
    return t.documents.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick(F.col("doc_id")), F.lit(" "), pick(F.floor(F.col("doc_id") / n))).alias("x"))


def _count(patterns, x: str = "x") -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {_quoted('(?i)' + p)}) AS INT)" for p in patterns) + ")"


def _distinct(patterns, x: str = "x") -> str:
    found = ", ".join(f"substr(regexp_extract({x}, {_quoted('(?i)' + p)}, 0), 1, 160)" for p in patterns)
    return f"list_distinct(list_filter([{found}], lambda v: v <> ''))"


def _case(pairs, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {_quoted(label)}" for test, label in pairs) + f" ELSE {_quoted(other)} END"


def _in(labels_) -> str:
    return "posture IN (" + ", ".join(map(_quoted, labels_)) + ")"


_KO = [(n, f"h{i}", _count(p)) for i, (n, p) in enumerate(L.POSTURE_KO)]
_OWN = [(f"d{i}", _count(p)) for i, (_, p) in enumerate(L.DIRECT_KO)]
_ELEMENTS = "(" + " + ".join(f"CAST({c} > 0 AS INT)" for c, _ in _OWN) + ")"
_DIRECT = f"(d0 > 0 AND d2 > 0 AND d3 > 0 AND {_ELEMENTS} >= 4)"
_CONTRACT = next(c for n, c, _ in _KO if n == "contract_or_payment")


@query(
    "cls6_posture_ko",
    f"WITH h AS (SELECT doc_id, {', '.join(f'{e} AS {c}' for _, c, e in _KO)}, {', '.join(f'{e} AS {c}' for c, e in _OWN)} FROM {_with(KOREAN)}), p AS (SELECT *, {_case([*[(f'{c} > 0', n) for n, c, _ in _KO], (_DIRECT, 'direct_tort_claim')], 'unclear')} AS posture FROM h) "
    f"SELECT doc_id, posture, CASE {' '.join(f'WHEN {c} > 0 THEN CASE WHEN {c} >= 2 THEN {_quoted('high')} ELSE {_quoted('medium')} END' for _, c, _ in _KO)} WHEN {_DIRECT} THEN CASE WHEN {_ELEMENTS} = 5 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence, "
    f"{_case([(f'{_in(['direct_tort_claim'])} AND {_CONTRACT} > 0', 'mixed_tort_contract'), (_in(['direct_tort_claim']), 'non_contractual_tort'), *[(_in(v), n) for n, v in L.BASIS_KO]], 'unclear')} AS basis FROM p",
)
def _(t):
    return _phrased(t, KOREAN).select("doc_id", labels.posture_ko("x").alias("p")).select("doc_id", "p.*")


@query("cls6_subtype_ko", f"SELECT doc_id, {_case([(f'{_count(p)} > 0', n) for n, p in L.SUBTYPE_KO], 'unclear')} AS subtype, {', '.join(f'regexp_matches(x, {_quoted(p)}) AS {n}' for n, p in L.HARM_KO)} FROM {_with(KOREAN)}")
def _(t):
    return _phrased(t, KOREAN).select("doc_id", labels.subtype_ko("x").alias("subtype"), labels.harms("x").alias("h")).select("doc_id", "subtype", "h.*")


_EN = [(n, f"h{i}", _distinct(p)) for i, (n, p) in enumerate(L.POSTURE_EN)]
_GROUPS = (("tort", L.TORT_EN), ("conduct", L.CONDUCT_EN), ("harm", L.HARM_EN), ("cause", L.CAUSATION_EN), ("plaintiff", L.PLAINTIFF_EN))
_GROUPED = "(CAST(len(tort) > 0 AS INT) + CAST(len(conduct) > 0 AS INT) + CAST(len(harm) > 0 AS INT) + CAST(len(plaintiff) > 0 AS INT))"
_EN_RULES = [
    *[(f"h{i} > 0" + (f" AND NOT ({_GROUPED} >= 4 AND h{i} < 2)" if n == "insurance_coverage" else ""), n, f"CASE WHEN h{i} >= 2 THEN 'high' ELSE 'medium' END") for i, (n, _) in enumerate(L.POSTURE_EN)],
    (f"{_GROUPED} >= 4 AND (len(cause) > 0 OR len(tort) >= 2)", "direct_tort_claim", "CASE WHEN len(cause) > 0 AND len(list_distinct(tort || conduct || harm || cause || plaintiff)) >= 6 THEN 'high' ELSE 'medium' END"),
    ("contract > 0 AND NOT (len(conduct) > 0 AND len(harm) > 0 AND len(plaintiff) > 0)", "contract_or_payment", "CASE WHEN contract >= 2 THEN 'high' ELSE 'medium' END"),
    ("rights > 0 AND len(tort) = 0", "civil_rights_only", "'medium'"),
    ("procedure > 0 AND NOT (len(conduct) > 0 AND len(harm) > 0)", "procedural_only", "'medium'"),
]


@query(
    "cls7_posture_en",
    f"WITH h AS (SELECT doc_id, {', '.join(f'len({e}) AS {c}' for _, c, e in _EN)}, {', '.join(f'{_distinct(p)} AS {n}' for n, p in _GROUPS)}, len({_distinct(L.CONTRACT_EN)}) AS contract, len({_distinct(L.CIVIL_RIGHTS_EN)}) AS rights, len({_distinct(L.PROCEDURAL_EN)}) AS procedure, len({_distinct(L.CONTRACT_BASIS_EN)}) AS basis_hits FROM {_with(ENGLISH, 30000)}), "
    f"p AS (SELECT *, {_case([(c, n) for c, n, _ in _EN_RULES], 'unclear')} AS posture FROM h) SELECT doc_id, posture, CASE {' '.join(f'WHEN {c} THEN {v}' for c, _, v in _EN_RULES)} ELSE 'low' END AS confidence, "
    f"{_case([(f'{_in(['direct_tort_claim'])} AND basis_hits >= 2', 'mixed_tort_contract'), (_in(['direct_tort_claim']), 'non_contractual_tort'), *[(_in(v), n) for n, v in L.BASIS_EN]], 'unclear')} AS basis FROM p",
)
def _(t):
    # the first 30,000 characters, as the rule itself says
    return _phrased(t, ENGLISH).select("doc_id", labels.posture_en(F.lit(""), F.lit(""), "x").alias("p")).select("doc_id", "p.*")


@query(
    "cls8_stage_en",
    f"WITH s AS (SELECT doc_id, x, {_case([(f'{_count([f'(?s){q}' for q in p])} > 0', n) for n, p in L.STAGES_EN], 'unknown')} AS stage FROM {_with(ENGLISH, 30000)}) SELECT doc_id, stage, {_case([*[(f'{_count([f'(?s){q}' for q in p])} > 0', n) for n, p in L.FACT_STATUS_EN], ("stage = 'demurrer_or_motion_to_dismiss'", 'assumed_true_for_pleading')], 'unclear')} AS fact_status FROM s",
)
def _(t):
    return _phrased(t, ENGLISH).select("doc_id", labels.stage_en("x").alias("s")).select("doc_id", "s.*")


_SCORES = [(n, f"s{i}", f"({_count(p)} * 3 + CASE WHEN {_count(p)} > 0 THEN {0 if n in L.GENERIC_EN else 2} ELSE 0 END)") for i, (n, p) in enumerate(L.SUBTYPE_EN)]
_BEST = f"greatest({', '.join(c for _, c, _ in _SCORES)})"


@query(
    "cls9_subtype_en",
    f"WITH s AS (SELECT doc_id, x, {', '.join(f'{e} AS {c}' for _, c, e in _SCORES)} FROM {_with(ENGLISH, 30000)}) SELECT doc_id, {_case([(f'{_BEST} <= 0', 'unclear'), *[(f'{c} = {_BEST}', n) for n, c, _ in _SCORES]], 'unclear')} AS subtype, {', '.join(f'regexp_matches(x, {_quoted('(?i)' + p)}) AS {n}' for n, p in L.HARM_FLAGS_EN)} FROM s",
)
def _(t):
    rows = _phrased(t, ENGLISH).select("doc_id", F.substring("x", 1, 30000).alias("x"))
    return rows.select("doc_id", labels.subtype_en("x").alias("subtype"), labels.harms("x", L.HARM_FLAGS_EN).alias("h")).select("doc_id", "subtype", "h.*")


NUMBERS = (("서울고등법원", "2010나123", "나"), ("대법원", "2010다5", "다"), ("", "", ""), ("서울중앙지방법원", "2011가합77", "가합"), ("부산지방법원 제2민사부 항소부", "", ""), ("", "2012다9", "다"))


@query(
    "cls10_court_ko",
    f"WITH c AS (SELECT doc_id, substr(x, 1, 5000) AS x, {[a for a, _, _ in NUMBERS]}[doc_id % 6 + 1] AS court, {[c for _, _, c in NUMBERS]}[doc_id % 6 + 1] AS code FROM (SELECT doc_id, {'[' + ', '.join(map(_quoted, KOREAN)) + ']'}[doc_id % 16 + 1] || ' ' || coalesce(text, '') AS x FROM documents)), "
    f"s AS (SELECT *, {_count([p for _, p in L.APPEAL_SIGNS_KO])} AS n_signs, {_count([p for _, p in L.SUPREME_SIGNS_KO])} > 0 AS supreme, contains(court, '고등법원') OR regexp_matches(court, '지방법원.*항소부') AS by_court, code = '나' AS by_number FROM c), "
    "r AS (SELECT *, contains(court, '대법원') OR (code = '다' AND n_signs = 0) AS top, CASE WHEN (by_court AND by_number OR n_signs >= 3) AND NOT supreme THEN 'high' WHEN n_signs >= 2 OR (by_court OR by_number) AND n_signs >= 1 THEN 'medium' ELSE 'low' END AS sure FROM s) "
    "SELECT doc_id, CASE WHEN top THEN 'supreme' WHEN sure <> 'low' THEN 'appellate' WHEN code IN ('가합', '가단', '가소') THEN 'trial' ELSE 'unknown' END AS level, CASE WHEN top THEN 'high' ELSE sure END AS confidence, n_signs FROM r",
)
def _(t):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    rows = t.documents.select("doc_id", F.concat(pick(KOREAN, 16), F.lit(" "), F.coalesce("text", F.lit(""))).alias("x"), *[pick([v[i] for v in NUMBERS], 6).alias(n) for i, n in enumerate(("court", "number", "code"))])
    return rows.select("doc_id", labels.court_ko("x", "court", "number", "code").alias("c")).select("doc_id", "c.*")


COURTS = (("California Court of Appeal", "California, CA", "SA"), ("Court of Appeal, Second Appellate District", "", ""), ("Supreme Court of California", "California, CA", "S"), ("United States District Court", "Federal", "FD"), ("Cal. Ct. App.", "", "SA"), ("", "Ohio", ""))
STATUS = ("Published", "Unpublished", "Precedential", "Non-Precedential", "Errata", "published in part")


@query(
    "cls11_court_ca",
    f"WITH c AS (SELECT doc_id, coalesce(text, '') AS text, {[a for a, _, _ in COURTS]}[doc_id % 6 + 1] AS n, {[b for _, b, _ in COURTS]}[doc_id % 6 + 1] AS j, {[k for _, _, k in COURTS]}[doc_id % 6 + 1] AS k, lower({list(STATUS)}[doc_id // 6 % 6 + 1]) AS p FROM documents), "
    f"s AS (SELECT *, {_count(L.APPEAL_COURTS_CA, 'n')} AS appeal, {_count(L.OTHER_COURTS_CA, chr(40) + 'n || chr(10) || j' + chr(41))} > 0 AS other, CAST(lower(j) IN ('california', 'california, ca', 'ca') AS INT) + CAST(k = 'SA' AS INT) AS meta, regexp_matches(j, '(?i)California(?:, CA)?') OR regexp_matches(n, '(?i)California|Cal\\. Ct\\.') AS here, regexp_matches(n || chr(10) || j, '(?i)United States|Federal|Ninth Circuit|District Court') AS federal FROM c) "
    "SELECT doc_id, CASE WHEN here AND NOT federal THEN 'california_state' ELSE 'other' END AS system, CASE WHEN appeal > 0 AND NOT other THEN 'intermediate_appellate' ELSE 'other' END AS level, CASE WHEN appeal > 0 AND NOT other AND meta > 0 THEN 'high' WHEN appeal > 0 AND NOT other AND appeal + meta >= 2 THEN 'medium' ELSE 'low' END AS confidence, "
    "CASE WHEN p = 'precedential' OR (contains(p, 'published') AND NOT contains(p, 'unpublished')) THEN 'published' WHEN regexp_matches(p, 'unpublished|non-precedential|nonprecedential') THEN 'unpublished' ELSE 'unknown' END AS publication, "
    f"{_count(L.CRIMINAL_EN, chr(40) + 'chr(10) || substr(text, 1, 15000)' + chr(41))} = 0 AS civil FROM s",
)
def _(t):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(n) if isinstance(n, str) else n, F.lit(6)) + 1).cast("int"))
    rows = t.documents.select("doc_id", "text", *[pick([v[i] for v in COURTS], "doc_id").alias(c) for i, c in enumerate(("n", "j", "k"))], pick(STATUS, F.floor(F.col("doc_id") / 6)).alias("p"))
    return rows.select("doc_id", labels.court_ca("n", "j", "k").alias("c"), labels.publication("p").alias("publication"), labels.civil(F.lit(""), "text", F.lit("unclear")).alias("civil")).select("doc_id", "c.*", "publication", "civil")


@query("cls12_other_civil", f"SELECT doc_id, CASE WHEN source = 'web' OR lang <> 'fr' THEN {_case([(f'regexp_matches(lower(x), {_quoted(p)})', n) for n, p in L.OTHER_CIVIL], 'other_economic_or_personal')} END AS kind FROM {_with(ENGLISH)} JOIN documents USING (doc_id)")
def _(t):
    rows = _phrased(t, ENGLISH).join(t.documents.select("doc_id", F.when((F.col("source") == "web") | (F.col("lang") != "fr"), "other_civil_liability").otherwise("none").alias("domain")), "doc_id")
    return rows.select("doc_id", labels.other_civil("domain", "x").alias("kind"))


NOTES = ("An attorney disciplinary matter.", "Workers' compensation only.", "The insurer alone.", "Notice/statute-of-limitations.", "Personal jurisdiction.", "Controlling-opinion missing.", "An extraordinary-writ.", "Something else.", "Claim/issue-preclusion.")


@query("cls13_note_code", f"SELECT doc_id, {_case([(f'contains(n, {_quoted(p)})', c) for p, c in L.NOTE_CODES], 'other_non_merits_proceeding')} AS code FROM (SELECT doc_id, lower([{', '.join(map(_quoted, NOTES))}][doc_id % {len(NOTES)} + 1] || ' ' || coalesce(text, '')) AS n FROM documents)")
def _(t):
    note = F.concat(F.element_at(F.array(*map(F.lit, NOTES)), (F.col("doc_id") % len(NOTES) + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", labels.note_code(note).alias("code"))


_FACTS = [(n, f"f{i}", [f"(?s){q}" for q in p]) for i, (n, p) in enumerate(L.FACTS_EN)]
_REQUIRED = sorted((n, c) for n, c, _ in _FACTS if n != "defense_or_dispute")
_ALL = " AND ".join(c for _, c, _ in _FACTS)


@query(
    "fct2_sufficiency_en",
    f"WITH f AS (SELECT doc_id, x, {', '.join(f'{_count(p)} > 0 AS {c}' for _, c, p in _FACTS)}, regexp_matches(x, {_quoted(L.FACT_HEADING_EN)}) AS heading, len(regexp_extract_all(x, '(?i){L.PROCEDURE_TERMS_EN}')) AS n_procedure, {' + '.join(f'len(regexp_extract_all(x, {_quoted('(?i)' + q)}))' for _, p in L.FACTS_EN for q in p)} AS n_facts FROM {_with(ENGLISH, 50000)}), "
    f"s AS (SELECT *, least(100, ({' + '.join(f'CAST({c} AS INT)' for _, c, _ in _FACTS)}) * 12 + CASE WHEN heading THEN 8 ELSE 0 END + CASE WHEN length(x) >= 5000 THEN 8 ELSE 0 END) AS score FROM f) "
    f"SELECT doc_id, score, CASE WHEN {_ALL} AND score >= 80 THEN CASE WHEN heading THEN 'self_contained' ELSE 'partially_incorporated' END ELSE 'insufficient' END AS quality, {_ALL} AND score >= 80 AS sufficient, "
    f"array_to_string(list_filter([{', '.join(f'CASE WHEN NOT {c} THEN {_quoted(f'missing_{n}')} END' for n, c in _REQUIRED)}, CASE WHEN NOT f{len(_FACTS) - 1} THEN 'missing_defense_or_disputed_facts' END, CASE WHEN n_procedure > greatest(30, n_facts * 4) AND NOT heading THEN 'procedural_or_legal_discussion_dominates' END], lambda v: v IS NOT NULL), ',') AS reasons FROM s",
)
def _(t):
    rows = _phrased(t, ENGLISH).select("doc_id", labels.facts_en("x", F.lit(True)).alias("f"))
    return rows.select("doc_id", "f.score", "f.quality", "f.sufficient", F.array_join("f.reasons", ",").alias("reasons"))


@query("fct2_sufficiency_ko")
def _(t):
    # the fact section needs a look ahead, which the SQL engine lacks; tests hold it against Python's re
    rows = _phrased(t, KOREAN).select("doc_id", labels.facts_ko("x").alias("f"))
    return rows.select("doc_id", "f.score", "f.quality", "f.independent", F.array_join("f.missing", ",").alias("missing"))


@query("str20_residue", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '[가-힣]{2,}'))), ',') AS words FROM " + _with(KOREAN))
def _(t):
    return _phrased(t, KOREAN).select("doc_id", F.array_join(labels.residue("x", "en"), ",").alias("words"))


_LOW = "lower(x)"


@query(
    "bil3_anchors",
    f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches({_LOW}, {_quoted('|'.join(v))}) THEN {_quoted(n)} END' for n, v in L.ANCHORS)}, CASE WHEN regexp_matches({_LOW}, {_quoted('|'.join(L.KNEW_NOT))}) THEN 'knowledge_negative' WHEN regexp_matches({_LOW}, {_quoted('|'.join(L.KNEW))}) THEN 'knowledge_positive' END], lambda v: v IS NOT NULL), ',') AS anchors FROM {_with(ENGLISH)}",
)
def _(t):
    return _phrased(t, ENGLISH).select("doc_id", F.array_join(labels.anchors("x"), ",").alias("anchors"))


@query("bil3_translated_facts")
def _(t):
    # each turn of a conversation beside its text without digits, so numbers are lost on purpose; lookarounds rule SQL out
    pair = t.conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("a")).withColumn("b", F.regexp_replace("a", "[0-9]", ""))
    f = pair.select("conv_id", "turn", "role", labels.translated_fact("a", "b", "ko").alias("f"))
    return f.select("conv_id", "turn", "role", F.array_join("f.errors", ",").alias("errors"), F.array_join("f.warnings", ",").alias("warnings"))


@query(
    "grd2_units",
    "WITH p AS (SELECT doc_id, 'H' || lpad(CAST(i AS VARCHAR), 3, '0') AS span_id, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)), u AS (SELECT doc_id, 'F001' AS fact_id, CASE doc_id % 3 WHEN 0 THEN 'H001' WHEN 1 THEN 'H002' ELSE 'L001' END AS span_id, CASE WHEN doc_id % 2 = 0 THEN string_split(text, chr(10))[1] ELSE 'other' END AS span FROM documents) "
    "SELECT u.doc_id, u.fact_id, u.span_id, CASE WHEN p.text IS NULL THEN 'fail' ELSE 'pass' END AS status, CASE WHEN p.text IS NOT NULL THEN CASE WHEN u.span = p.text THEN 'exact' ELSE 'canonicalized_from_source_span_id' END END AS copy_status, md5(coalesce(p.text, u.span)) AS span FROM u LEFT JOIN p USING (doc_id, span_id)",
)
def _(t):
    parts = F.split("text", "\n")
    passages = t.documents.select("doc_id", F.posexplode(parts).alias("i", "text")).select("doc_id", F.format_string("H%03d", F.col("i") + 1).alias("span_id"), "text", F.lit(0).alias("start"), F.length("text").alias("end"))
    kind = F.when(F.col("doc_id") % 3 == 0, "H001").when(F.col("doc_id") % 3 == 1, "H002").otherwise("L001")
    units = t.documents.select("doc_id", F.lit("F001").alias("fact_id"), F.lit("highest_court").alias("level"), kind.alias("span_id"), F.when(F.col("doc_id") % 2 == 0, parts[0]).otherwise("other").alias("span"))
    return labels.grounded_units(units, passages).select("doc_id", "fact_id", "span_id", "status", "copy_status", F.md5("span").alias("span"))


_BODY = "coalesce(text, '') || chr(10) || 'OPINION' || chr(10) || 'The plaintiff sought damages for negligence.'"


@query(
    "pre1_records",
    f"WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_BODY}, '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM documents WHERE length(text) > 200 AND NOT regexp_matches(text, '(?i)opinion|order|footnotes|notes|page|judge|background|\\*[0-9]|\\[|&|no\\.? |[0-9]+ +f\\.|[0-9]+ u\\.s') AND NOT regexp_matches(text, '[^ -~\\n]')) "
    f"SELECT doc_id AS case_id, 'trial' AS court_level, CAST(length(x) AS INT) AS raw_char_count, '2010-03-04' AS decision_date, true AS has_marker, CAST(length('OPINION' || chr(10) || 'The plaintiff sought damages for negligence.') AS INT) AS reasoning_char_count, 7 AS token_count, 1 AS sentence_count, array_to_string(list_filter([{', '.join(f'CASE WHEN contains(lower(x), {_quoted(k)}) THEN {_quoted(k)} END' for k in L.KEYWORDS_EN)}], lambda v: v IS NOT NULL), '; ') AS keywords FROM t",
)
def _(t):
    from ..operators.records import preprocessed

    # plain English texts without marks of their own, so that the body's mark is the one that is added
    plain = t.documents.filter((F.length("text") > 200) & ~F.col("text").rlike(r"(?i)opinion|order|footnotes|notes|page|judge|background|\*[0-9]|\[|&|no\.? |[0-9]+ +f\.|[0-9]+ u\.s") & ~F.col("text").rlike(r"[^ -~\n]"))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\nOPINION\nThe plaintiff sought damages for negligence."))
    rows = plain.select(F.col("doc_id").alias("case_id"), body.alias("raw_text"), F.lit("District Court").alias("court_name"), F.lit("2010. 3. 4.").alias("decision_date"), F.lit(None).cast("string").alias("number"), F.lit("").alias("level"))
    return preprocessed(rows, korean=False).select("case_id", "court_level", "raw_char_count", "decision_date", "has_marker", "reasoning_char_count", "token_count", "sentence_count", "keywords")


@query("fpt1_fact_patterns")
def _(t):
    from ..operators.fact_patterns import fact_patterns

    # half of the texts get a heading of facts, so that both ways occur
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Opinion\nFACTS\n"), F.coalesce("text", F.lit("")), F.lit("\nDISCUSSION\nHe is liable."))).otherwise(F.col("text"))
    rows = t.documents.select(F.col("doc_id").alias("case_id"), text.alias("raw_text"), F.lit("").alias("title"), F.lit("").alias("court"))
    p = fact_patterns(rows, korean=False)
    return p.select("case_id", "status", "excluded_reason", "method", F.array_join("flags", ",").alias("flags"), F.length("fact").alias("n_chars"))
