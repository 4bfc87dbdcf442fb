"""Queries on dedup, linkage, samples, allocation and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as sc
from ..operators import allocation, dedup, stats
from ..operators import rows as op
from .registry import query

# ---- dedup and linkage


@query("ded3_first_per_text", "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("h")


@query("ded4_shared_keys", "WITH k AS (SELECT doc_id, 'head' AS key, md5(substr(text, 1, 80)) AS v FROM documents UNION ALL SELECT doc_id, 'text', md5(text) FROM documents), s AS (SELECT key, v FROM k GROUP BY ALL HAVING count(*) > 1) SELECT doc_id, count(*) AS n_keys, string_agg(key, ',' ORDER BY key) AS keys FROM k JOIN s USING (key, v) GROUP BY 1")
def _(t):
    return op.multi_key_groups(t.documents.select("doc_id", F.md5(F.substring("text", 1, 80)).alias("head"), F.md5("text").alias("text")), "doc_id", ["head", "text"])


@query("ded6_cascade")
def _(t):
    keyed = t.documents.select("doc_id", F.md5(F.substring("text", 1, 120)).alias("head"), F.md5("text").alias("whole"))
    return dedup.first_wins(keyed, "doc_id", ["head", "whole"], losers_register=False)


@query(
    "ded7_cascade_losers_register",
    "WITH k AS (SELECT doc_id, md5(substr(text, 1, 120)) AS head, md5(text) AS whole FROM documents), a AS (SELECT head AS v, min(doc_id) AS f FROM k GROUP BY 1), b AS (SELECT whole AS v, min(doc_id) AS f FROM k GROUP BY 1) SELECT doc_id, a.f = doc_id AND b.f = doc_id AS kept, CASE WHEN a.f < doc_id THEN 'head' WHEN b.f < doc_id THEN 'whole' END AS because, CASE WHEN a.f < doc_id THEN a.f WHEN b.f < doc_id THEN b.f END AS of FROM k JOIN a ON a.v = head JOIN b ON b.v = whole",
)
def _(t):
    keyed = t.documents.select("doc_id", F.md5(F.substring("text", 1, 120)).alias("head"), F.md5("text").alias("whole"))
    return dedup.first_wins(keyed, "doc_id", ["head", "whole"], losers_register=True)


@query("ded9_same_number_groups", "SELECT doc_id, 'GRP_' || substr(sha256(source || ':' || lang), 1, 12) AS grp FROM documents QUALIFY count(*) OVER (PARTITION BY source, lang) > 1")
def _(t):
    shared = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return t.documents.select("doc_id", "source", "lang").join(shared, ["source", "lang"]).select("doc_id", F.concat(F.lit("GRP_"), F.substring(F.sha2(F.concat_ws(":", "source", "lang"), 256), 1, 12)).alias("grp"))


@query(
    "ded12_containment",
    r"WITH u AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS unit, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS pos FROM documents) SELECT doc_id, pos FROM u a WHERE length(unit) >= 40 AND EXISTS (SELECT 1 FROM u b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND contains(b.unit, a.unit))",
)
def _(t):
    return dedup.contained(t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "unit")), "doc_id", "pos", "unit", 40)


@query("snk5_upsert", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' ELSE p_brand END AS p_brand FROM part")
def _(t):
    return op.upsert(t.part.select("p_partkey", "p_brand"), t.part.filter("p_size < 10").select("p_partkey", F.lit("small").alias("p_brand")), ["p_partkey"])


@query("snk13_canonical_sync", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS selected FROM customer")
def _(t):
    chosen = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("s", F.lit(True))
    return t.customer.select("c_custkey").join(chosen, "c_custkey", "left").select("c_custkey", F.coalesce("s", F.lit(False)).alias("selected"))


@query("src17_fallback_chain", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(trim(url), ''), 'none') AS name FROM pages")
def _(t):
    title = F.btrim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return t.pages.select("page_id", F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.btrim("url"), F.lit("")), F.lit("none")).alias("name"))


# ---- samples and allocation


@query("smp1_quota_fill", "WITH r AS (SELECT doc_id, lang, sha256('q1|' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha256('q1|' || doc_id)) AS rank FROM documents), p AS (SELECT *, CASE WHEN rank <= CASE lang WHEN 'en' THEN 45 WHEN 'de' THEN 25 WHEN 'fr' THEN 15 ELSE 0 END THEN 'quota' ELSE 'fill' END AS pool FROM r) SELECT doc_id, lang, pool FROM p ORDER BY CASE WHEN pool = 'quota' THEN 0 ELSE 1 END, h LIMIT 100")
def _(t):
    rows = t.documents.select("doc_id", "lang", op.hash_order("doc_id", "q1").alias("h"))
    return op.quota_fill(rows, "lang", {"en": 45, "de": 25, "fr": 15}, 100, F.col("h")).drop("h")


@query("smp6_ranking_score", "SELECT c_nationkey, CAST(count(*) + count(*) FILTER (WHERE c_acctbal > 5000) // 10 + 25 * count(DISTINCT c_mktsegment) AS BIGINT) AS score FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_nationkey").agg((F.count(F.lit(1)) + F.floor(F.count_if(F.col("c_acctbal") > 5000) / 10) + 25 * F.count_distinct("c_mktsegment")).alias("score"))


@query("smp7_max_flow")
def _(t):
    c = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).collect()  # nations x segments
    edges = {(f"s{r[0]}", f"d{r[1]}"): int(r[2]) for r in c}
    edges |= {("S", f"s{r[0]}"): 20 for r in c} | {(f"d{r[1]}", "T"): 60 for r in c}
    total, flow = allocation.max_flow(edges, "S", "T")
    return t.spark.createDataFrame([(total, sum(n for (u, _), n in flow.items() if u == "S"))], "total long, sent long")


@query("smp11_largest_remainder", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT lang, n * 100.0 / sum(n) OVER () AS q FROM c), r AS (SELECT lang, CAST(floor(q) AS BIGINT) AS f, row_number() OVER (ORDER BY q - floor(q) DESC, lang) AS k, 100 - sum(floor(q)) OVER () AS rest FROM q) SELECT lang, f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS seats FROM r")
def _(t):
    c = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return op.largest_remainder(c, "lang", "n", 100).select("lang", "seats")


@query("smp12_split", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha256('split|' || doc_id)) <= 20 THEN 'dev' ELSE 'confirmatory' END AS part FROM documents")
def _(t):
    # the 20 of each language are found first, so only they and ids meet again
    dev = op.top_per(t.documents.select("doc_id", "lang"), ["lang"], 20, op.hash_order("doc_id", "split")).select("doc_id", F.lit("dev").alias("d"))
    return t.documents.select("doc_id").join(dev, "doc_id", "left").select("doc_id", F.coalesce("d", F.lit("confirmatory")).alias("part"))


@query("smp13_distinct_first", "WITH b AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT doc_id, source FROM b ORDER BY k, n_chars DESC, doc_id LIMIT 25")
def _(t):
    b = op.top_per(t.documents.select("doc_id", "source", "n_chars"), ["source"], 25, F.desc("n_chars"), F.col("doc_id"), rank="k")
    return b.orderBy("k", F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "source")


@query("smp14_review_sample", "SELECT doc_id, reason FROM (SELECT doc_id, 'toxic' AS reason FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'stratum' FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256('rev|' || doc_id)) AS k FROM labels) WHERE k <= 2)")
def _(t):
    two = op.top_per(t.labels, ["quality", "toxic"], 2, op.hash_order("doc_id", "rev")).select("doc_id", F.lit("stratum").alias("reason"))
    return t.labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("reason")).unionByName(two).distinct()


@query("smp16_alignment", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_customers, coalesce(b.n, 0) AS n_suppliers, greatest(coalesce(b.n, 0) * 10 - coalesce(a.n, 0), 0) AS shortage FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def _(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    j = a.join(b, "k", "full_outer").select("k", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))
    return j.withColumn("shortage", F.greatest(F.col("n_suppliers") * 10 - F.col("n_customers"), F.lit(0)))


@query("smp17_validation_sample", "SELECT doc_id FROM (SELECT doc_id FROM documents WHERE contains(text, '@') UNION SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('val|' || doc_id)) <= 10)")
def _(t):
    ten = op.top_per(t.documents.select("doc_id", "lang"), ["lang"], 10, op.hash_order("doc_id", "val")).select("doc_id")
    return t.documents.filter(F.contains("text", F.lit("@"))).select("doc_id").unionByName(ten).distinct()


# ---- statistics


@query("sta1_cliffs_delta", "WITH x AS (SELECT n_chars AS v FROM documents WHERE lang = 'en'), y AS (SELECT n_chars AS v FROM documents WHERE lang = 'de') SELECT (SELECT count(*) FROM x) AS n_first, (SELECT count(*) FROM y) AS n_second, round(avg(CASE WHEN x.v > y.v THEN 1 WHEN x.v < y.v THEN -1 ELSE 0 END), 8) AS cliffs_delta FROM x, y")
def _(t):
    return stats.rank_counts(t.documents, "lang", "n_chars", "en", "de").select("n_first", "n_second", F.round("cliffs_delta", 8).alias("cliffs_delta"))


@query(
    "sta2_mann_whitney",
    "WITH c AS (SELECT n_chars AS v, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'de') AS b FROM documents WHERE lang IN ('en', 'de') GROUP BY 1), r AS (SELECT *, a + b AS t, coalesce(sum(a + b) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (a + b + 1) / 2.0 AS rank FROM c), s AS (SELECT sum(a)::DOUBLE AS n, sum(b)::DOUBLE AS m, sum(a * rank)::DOUBLE AS r, sum(t::DOUBLE ** 3 - t) AS ties FROM r) SELECT n::BIGINT AS n_first, m::BIGINT AS n_second, r - n * (n + 1) / 2 AS u, round((r - n * (n + 1) / 2 - n * m / 2) / sqrt(n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1)))), 6) AS z FROM s",
)
def _(t):
    return stats.rank_counts(t.documents, "lang", "n_chars", "en", "de").select("n_first", "n_second", F.col("u").cast("double").alias("u"), F.round("z", 6).alias("z"))


@query("sta3_bootstrap")
def _(t):
    return stats.bootstrap_mean(t.documents, "n_chars", "doc_id")


@query("sta4_sign_flip")
def _(t):
    return stats.sign_flip(stats.paired(t.events, ["user_id"], "event_type", "value", "click", "view"), "difference", "user_id")


@query("sta5_adjusted", "WITH p AS (SELECT c_nationkey AS k, count(*) / 1000.0 AS p FROM customer GROUP BY 1), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS n FROM p) SELECT k, round(least(1.0, min(p * n / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 8) AS adjusted FROM r")
def _(t):
    p = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg((F.count(F.lit(1)) / 1000.0).alias("p"))
    return stats.benjamini_hochberg(p, "p", "k").select("k", F.round("adjusted", 8).alias("adjusted"))


@query("sta6_discordant", "SELECT count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS only_first, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS only_second FROM labels")
def _(t):
    return stats.discordant(t.labels.select((F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("x")), "q", "x")


@query("sta7_kappa", "WITH j AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels GROUP BY ALL), s AS (SELECT sum(n) AS n FROM j), a AS (SELECT x, sum(n) AS a FROM j GROUP BY 1), b AS (SELECT y, sum(n) AS b FROM j GROUP BY 1), e AS (SELECT sum(a * b) AS ab FROM a JOIN b ON x = y) SELECT CAST(s.n AS BIGINT) AS n, round((SELECT sum(n) FROM j WHERE x = y) / s.n, 8) AS agreement, round(((SELECT sum(n) FROM j WHERE x = y) / s.n - ab / s.n / s.n) / (1 - ab / s.n / s.n), 8) AS kappa FROM s, e")
def _(t):
    return stats.kappa(t.labels, "quality", "toxic").select("n", F.round("agreement", 8).alias("agreement"), F.round("kappa", 8).alias("kappa"))


@query("sta8_divergence", "WITH c AS (SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE event_type <> 'click') AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE NOT value > 50) AS DOUBLE) AS d FROM events GROUP BY 1), s AS (SELECT user_id, a / (a + b) AS p, b / (a + b) AS q, c / (c + d) AS r, d / (c + d) AS s FROM c WHERE c + d > 0) SELECT user_id, round((CASE WHEN p > 0 THEN p * log2(p / ((p + r) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((q + s) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((p + r) / 2)) ELSE 0 END + CASE WHEN s > 0 THEN s * log2(s / ((q + s) / 2)) ELSE 0 END) / 2, 8) AS js FROM s")
def _(t):
    c = t.events.groupBy("user_id").agg(F.array(F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") != "click")).alias("p"), F.array(F.count_if(F.col("value") > 50), F.count_if(~(F.col("value") > 50))).alias("q"))
    return c.filter("q[0] + q[1] > 0").select("user_id", F.round(sc.js_divergence(F.col("p"), F.col("q")), 8).alias("js"))


@query("sta10_paired_differences", "SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type = 'view' THEN value END), 6) AS difference FROM events GROUP BY 1 HAVING difference IS NOT NULL")
def _(t):
    return stats.paired(t.events, ["user_id"], "event_type", "value", "click", "view").select("user_id", F.round("difference", 6).alias("difference"))


@query("sta12_components")
def _(t):
    d = t.documents.select("doc_id", F.log1p("n_chars").alias("a"), F.log1p(F.regexp_count("text", F.lit("[.!?]"))).alias("b"), F.log1p(F.regexp_count("text", F.lit("\n"))).alias("c"))
    return stats.principal(d, ["a", "b", "c"]).select("doc_id", "pc1", "pc2")


@query("sta13_dispersion", "WITH c AS (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY 1) SELECT lang, count(*) AS n, round(avg(abs(n_chars - m)), 4) AS mean_distance FROM documents JOIN c USING (lang) GROUP BY 1")
def _(t):
    return stats.dispersion(t.documents, "lang", ["n_chars"]).select("lang", "n", F.round("mean_distance", 4).alias("mean_distance"))


@query("sta13_dispersion_test")
def _(t):
    return stats.dispersion_test(t.documents, "lang", ["n_chars"], "doc_id")


@query("mth4_line", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(t):
    return stats.line(t.lineitem, "l_extendedprice", "l_quantity", "l_returnflag").select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), "n")


@query("sta11_instability", "WITH r AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, round(avg(CAST(event_type <> p AS INT)), 8) AS changes FROM r WHERE p IS NOT NULL GROUP BY 1")
def _(t):
    r = t.events.select("user_id", "event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("p"))
    return r.filter("p IS NOT NULL").groupBy("user_id").agg(F.round(F.avg((F.col("event_type") != F.col("p")).cast("int")), 8).alias("changes"))
