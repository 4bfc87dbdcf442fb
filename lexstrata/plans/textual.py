"""Queries on text, dates and numbers, classifiers and lexicons over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import lexicon, rules
from ..operators import rows as op
from .registry import query


@query("str1_squeeze", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.squeeze("text")).alias("h"))


@query("str4_hashes", "SELECT doc_id, sha256(text) AS s256, sha1(text) AS s1, substr(sha256(text), 1, 16) AS short FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.sha("text").alias("s256"), F.sha1("text").alias("s1"), tx.sha("text", 16).alias("short"))


@query("str5_canonical_json", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS h FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "source")), 256).alias("h"))


@query("str6_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[가-힣]+|[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*|§')) AS BIGINT) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(tx.tokens("text")).cast("long").alias("n"))


@query("str9_excerpt", r"SELECT doc_id, CASE WHEN length(y) <= 120 THEN y WHEN regexp_extract(substr(y, 1, 120), '^(.*[.!?])(?:\s|$)', 1) <> '' THEN regexp_extract(substr(y, 1, 120), '^(.*[.!?])(?:\s|$)', 1) ELSE substr(y, 1, 120) END AS head FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS y FROM documents)")
def _(t):
    return t.documents.select("doc_id", tx.excerpt("text", 120).alias("head"))


@query("str11_strip", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '[A-Z][a-z]+\\.', 'X.', 'g')) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.replaced("text", [("[0-9]+", "#"), (r"[A-Z][a-z]+\.", "X.")])).alias("h"))


@query("str13_redact_numbers", "SELECT doc_id, md5(regexp_replace(text, '\\+[0-9][0-9 ().-]+[0-9]', '[PHONE]', 'g')) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.replaced("text", [(r"\+[0-9][0-9 ().-]+[0-9]", "[PHONE]")])).alias("h"))


@query("str14_evidence", "SELECT doc_id, array_to_string(w[1:12], '|') AS found FROM (SELECT doc_id, list(m ORDER BY i) AS w FROM (SELECT doc_id, m, min(i) AS i FROM (SELECT doc_id, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, 'th[a-z]{6,}') AS x FROM documents)) GROUP BY ALL) GROUP BY 1) UNION ALL SELECT doc_id, '' FROM documents WHERE NOT regexp_matches(text, 'th[a-z]{6,}')")
def _(t):
    return t.documents.select("doc_id", F.array_join(tx.hits("text", "th[a-z]{6,}"), "|").alias("found"))


@query("str16_terms", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 + (length(text) - length(replace(text, 'tion', ''))) / 4 AS BIGINT) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.term_count("text", ["the", "tion"]).alias("n"))


@query("str17_shared_shingles", "WITH w AS (SELECT DISTINCT doc_id AS id, list_aggregate(s[i:i+4], 'string_agg', ' ') AS g FROM (SELECT doc_id, string_split(text, ' ') AS s, unnest(generate_series(1, len(string_split(text, ' ')) - 4)) AS i FROM documents)), v AS (SELECT DISTINCT item_id, list_aggregate(s[i:i+4], 'string_agg', ' ') AS g FROM (SELECT item_id, string_split(text, ' ') AS s, unnest(generate_series(1, len(string_split(text, ' ')) - 4)) AS i FROM benchmark)) SELECT id AS doc_id, item_id, count(*) AS n FROM w JOIN v USING (g) GROUP BY ALL")
def _(t):
    a = t.documents.select("doc_id", F.explode_outer(tx.shingles(F.split("text", " "), 5)).alias("g")).distinct()
    b = t.benchmark.select("item_id", F.explode_outer(tx.shingles(F.split("text", " "), 5)).alias("g")).distinct()
    return a.join(b, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("str19_script_share", "SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z]')) / nullif(length(text), 0), 6) AS share FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(F.regexp_count("text", F.lit("[A-Za-z]")) / F.nullif(F.length("text"), F.lit(0)), 6).alias("share"))


@query("str21_slug", "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9가-힣]+', '-', 'g'), '-') AS slug FROM pages")
def _(t):
    return t.pages.select("page_id", tx.slug("url").alias("slug"))


@query("str22_alpha", "WITH RECURSIVE m AS (SELECT p_partkey, p_partkey AS k, '' AS mark FROM part UNION ALL SELECT p_partkey, (k - 1) // 26, chr(CAST(65 + (k - 1) % 26 AS INT)) || mark FROM m WHERE k > 0) SELECT p_partkey, mark FROM m WHERE k = 0")
def _(t):
    return t.part.select("p_partkey", tx.alpha_suffix("p_partkey").alias("mark"))


@query("str24_secrets", "SELECT doc_id, regexp_matches(text, '[0-9a-f]{32,}') AS had, md5(regexp_replace(text, '[0-9a-f]{32,}', '[REDACTED]', 'g')) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.col("text").rlike("[0-9a-f]{32,}").alias("had"), F.md5(tx.replaced("text", [("[0-9a-f]{32,}", "[REDACTED]")])).alias("h"))


@query("dat1_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(t):
    return t.orders.select("o_orderkey", sc.date_text(F.date_format("o_orderdate", "yyyy. M. d.")).alias("day"))


@query("dat5_years", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(least(year(o_orderdate) - ((year(o_orderdate) - 2000) % 5 + 5) % 5, 2020) AS INT) AS period, CAST(year(o_orderdate) // 10 * 10 AS INT) AS decade FROM orders")
def _(t):
    y = sc.year_of(F.date_format("o_orderdate", "'in' yyyy"))
    return t.orders.select("o_orderkey", y.alias("y"), sc.five_years(y).cast("int").alias("period"), sc.decade(y).alias("decade"))


@query("dat8_era", "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1993 THEN 'early' WHEN year(o_orderdate) < 1996 THEN 'middle' ELSE 'late' END AS era FROM orders")
def _(t):
    return t.orders.select("o_orderkey", sc.era(F.year("o_orderdate"), [1993, 1996], ["early", "middle", "late"]).alias("era"))


@query("mth2_position", "SELECT doc_id, CASE WHEN strpos(text, 'tion') > 0 THEN round(CAST(strpos(text, 'tion') - 1 AS DOUBLE) / length(text), 3) ELSE -1 END AS place FROM documents")
def _(t):
    at = F.regexp_instr("text", F.lit("tion"))
    return t.documents.select("doc_id", F.when(at > 0, F.round((at - 1) / F.length("text"), 3)).otherwise(-1.0).alias("place"))


@query("mth6_stable_random", "SELECT doc_id, round(CAST('0x' || substr(sha256('r|' || doc_id), 1, 8) AS BIGINT) / 4294967296, 9) AS u FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(sc.unit_interval(F.concat(F.lit("r|"), F.col("doc_id").cast("string"))), 9).alias("u"))


@query("ded1_stable_id", "SELECT doc_id, 'DOC_' || substr(sha256(source || chr(31) || lang || chr(31) || text), 1, 18) AS id FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.stable_id("DOC", "source", "lang", "text").alias("id"))


@query("ded10_normal_hash", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.normal_hash("text").alias("h"))


@query("ded11_repeated_lines", "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, lower(trim(unnest(string_split(text, chr(10))))) AS line FROM documents) WHERE length(line) >= 15 GROUP BY ALL HAVING count(*) > 1")
def _(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", F.lower(F.btrim("l")).alias("line"))
    return lines.filter(F.length("line") >= 15).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("cls1_weighted_domain", "WITH s AS (SELECT doc_id, least(len(regexp_extract_all(text, '(?i)that|hea')), 5) * 2 AS a, least(len(regexp_extract_all(text, '(?i)tion|ment')), 5) AS b FROM documents) SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 'none' WHEN a >= b THEN 'a' ELSE 'b' END AS domain, CAST(greatest(a, b) AS INT) AS score FROM s")
def _(t):
    a = F.least(F.regexp_count("text", F.lit("(?i)that|hea")), F.lit(5)) * 2
    b = F.least(F.regexp_count("text", F.lit("(?i)tion|ment")), F.lit(5))
    return t.documents.select("doc_id", op.first_of([((a == 0) & (b == 0), "none"), (a >= b, "a")], "b").alias("domain"), F.greatest(a, b).alias("score"))


@query("cls2_case_domain", "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)casino|bets') THEN 'gambling' WHEN regexp_matches(url, '(?i)pills') THEN 'pharmacy' WHEN regexp_matches(url, '(?i)spam|ads') THEN 'ads' ELSE 'other' END AS domain FROM pages")
def _(t):
    rules_ = [("(?i)casino|bets", "gambling"), ("(?i)pills", "pharmacy"), ("(?i)spam|ads", "ads")]
    return t.pages.select("page_id", op.first_of([(F.col("url").rlike(p), n) for p, n in rules_], "other").alias("domain"))


@query("cls_domain_rules")
def _(t):
    d = rules.domain("text")
    return t.documents.select("doc_id", d.alias("d")).select("doc_id", "d.domain", "d.score", "d.confidence", F.array_join("d.tags", ",").alias("tags"))


@query("fct1_sufficiency", r"SELECT doc_id, CAST(a + b + c AS INT) AS score, a + b = 2 AS core FROM (SELECT doc_id, CAST(regexp_matches(substr(text, 1, 80000), '(?i)the|der') AS INT) AS a, CAST(regexp_matches(substr(text, 1, 80000), '(?i)ment|tion') AS INT) AS b, CAST(regexp_matches(substr(text, 1, 80000), '\b[0-9]{4}\b') AS INT) AS c FROM documents)")
def _(t):
    head = F.substring("text", 1, 80000)
    a, b, c = (head.rlike(p).cast("int") for p in ("(?i)the|der", "(?i)ment|tion", r"\b[0-9]{4}\b"))
    return t.documents.select("doc_id", (a + b + c).alias("score"), (a + b == 2).alias("core"))


@query("grd1_grounding", "SELECT d.doc_id, b.item_id, CAST(strpos(d.text, b.text) - 1 AS INT) AS start FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(t):
    # whole items inside documents: candidates by the item's first five words (ids only), then the exact place
    w = lambda x: F.split(x, r"\s+")
    b = t.benchmark.select("item_id", F.col("text").alias("span"), tx.shingles(F.slice(w("text"), 1, 5), 5)[0].alias("g"))
    d = t.documents.select("doc_id", F.explode_outer(tx.shingles(w("text"), 5)).alias("g"))
    pairs = d.join(b.select("item_id", "g"), "g").select("doc_id", "item_id").distinct()
    j = pairs.join(b.drop("g"), "item_id").join(t.documents, "doc_id")
    return j.select("doc_id", "item_id", (F.call_function("instr", F.col("text"), F.col("span")) - 1).alias("start")).filter("start >= 0")


@query("lek3_leak_triplet", "SELECT doc_id, regexp_matches(text, '(?i)licen[sc]ed?') AS license, regexp_matches(text, '(?i)copyright|rights reserved') AS rights, regexp_matches(text, '[\\w.]+@[\\w.]+') AS address FROM documents")
def _(t):
    return t.documents.select("doc_id", F.col("text").rlike("(?i)licen[sc]ed?").alias("license"), F.col("text").rlike("(?i)copyright|rights reserved").alias("rights"), F.col("text").rlike(r"[\w.]+@[\w.]+").alias("address"))


_TERMS = {"doctrine": X.DOCTRINE, "remedy": X.REMEDY, "procedure": X.PROCEDURE, "jurisdiction": X.JURISDICTION}
_TERM_SUMS = {k: " + ".join(f"(length(low) - length(replace(low, '{w.lower()}', ''))) // {len(w)}" for w in v) for k, v in _TERMS.items()}
_SENTENCES = r"greatest(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?。])\s+|\n+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 1)), 1)"


@query(
    "fea1_features",
    f"WITH b AS (SELECT doc_id, text, lower(text) AS low, len(regexp_extract_all(text, '{X.TOKEN.replace(chr(39), chr(39) * 2)}')) AS n, {_SENTENCES} AS s FROM documents), k AS (SELECT doc_id, n, s, {', '.join(f'{v} AS {c}' for c, v in _TERM_SUMS.items())} FROM b) SELECT doc_id, n::BIGINT AS n_tokens, s::BIGINT AS n_sentences, round_even(n / s, 4) AS avg_sentence, {', '.join(f'{c}::BIGINT AS {c}_terms, CASE WHEN n > 0 THEN round_even({c} / n * 1000, 4) ELSE 0 END AS {c}_per_1k' for c in _TERMS)} FROM k",
)
def _(t):
    return rules.features(t.documents)


@query("fea1_simple", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) AS n_marks FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]+")).cast("long").alias("n_words"), F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("n_marks"))


FORMS = [
    {"surface_id": "s1", "concept_id": "c1", "category": "doctrine", "family": "f1", "scope": "x", "form": "that the", "language": "en"},
    {"surface_id": "s2", "concept_id": "c2", "category": "doctrine", "family": "f1", "scope": "x", "form": "the", "language": "en"},
    {"surface_id": "s3", "concept_id": "c3", "category": "remedy", "family": "f2", "scope": "x", "form": "the", "language": "en"},
    {"surface_id": "s4", "concept_id": "c4", "category": "remedy", "family": "f3", "scope": "y", "form": "of", "language": "en"},
]


@query("lex1_hits", r"SELECT doc_id, CAST(len(regexp_extract_all(' ' || regexp_replace(text, '[^A-Za-z0-9]', '  ', 'g') || ' ', '(?i) of ')) AS BIGINT) AS n FROM documents WHERE regexp_matches(' ' || regexp_replace(text, '[^A-Za-z0-9]', '  ', 'g') || ' ', '(?i) of ')")
def _(t):
    return lexicon.hits(t.documents, FORMS[3:]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("lex3_longest_spans")
def _(t):
    return lexicon.longest(lexicon.resolved(lexicon.hits(t.documents, FORMS)), {"remedy": "doctrine"})


@query("lex4_summary")
def _(t):
    return lexicon.summary(lexicon.longest(lexicon.resolved(lexicon.hits(t.documents, FORMS)), {"remedy": "doctrine"}))


@query("seg1_segments", "SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) WHERE length(trim(s)) > 0 GROUP BY 1")
def _(t):
    s = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("s")).filter(F.length(F.btrim("s")) > 0)
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


@query("qc3_named_checks", "SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 100 THEN 'length' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN NOT regexp_matches(text, '[.!?]') THEN 'sentences' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents")
def _(t):
    checked = op.with_reasons(t.documents, [("length", F.col("n_chars") >= 100), ("table", ~F.contains("text", F.lit("|"))), ("sentences", F.col("text").rlike("[.!?]"))], "failed", "passes")
    return checked.select("doc_id", F.array_join("failed", ",").alias("failed"))


@query("qc5_invariants", "SELECT count(*) = count(DISTINCT doc_id) AS ids_unique, bool_and(length(text) = n_chars) AS lengths_hold, bool_and(lang IN ('en', 'de', 'fr', 'es')) AS languages_known FROM documents")
def _(t):
    return t.documents.agg((F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("ids_unique"), F.bool_and(F.length("text") == F.col("n_chars")).alias("lengths_hold"), F.bool_and(F.col("lang").isin("en", "de", "fr", "es")).alias("languages_known"))


@query("qc6_unlogged_changes", "SELECT c_custkey, 'c_acctbal' AS field FROM customer WHERE c_acctbal < 0 AND c_custkey % 2 = 1")
def _(t):
    before = t.customer.select("c_custkey", "c_acctbal")
    changed = op.changed_fields(before, before.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0))), "c_custkey")
    logged = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("c_acctbal").alias("field"))
    return changed.join(logged, ["c_custkey", "field"], "left_anti")


@query("qc14_batch_gate", "SELECT count(*) AS n, avg(CAST(toxic AS DOUBLE)) > 0.05 AS blocked FROM labels")
def _(t):
    return t.labels.agg(F.count(F.lit(1)).alias("n"), (F.avg("toxic") > 0.05).alias("blocked"))


@query("qc13_first_failed_stage", "SELECT d.doc_id, CASE WHEN n_chars < 100 THEN 'segment' WHEN l.doc_id IS NULL THEN 'label' WHEN quality = 0 THEN 'quality' WHEN toxic = 1 THEN 'toxicity' END AS failed_at FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    j = t.documents.select("doc_id", "n_chars").join(t.labels.withColumn("there", F.lit(True)), "doc_id", "left")
    return j.select("doc_id", op.first_of([(F.col("n_chars") < 100, "segment"), (F.col("there").isNull(), "label"), (F.col("quality") == 0, "quality"), (F.col("toxic") == 1, "toxicity")]).alias("failed_at"))
