"""Queries on projections, filters, joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as sc
from ..operators import rows as op
from .registry import query

# ---- projections


@query("prj1_metadata_only", "SELECT doc_id, lang, source FROM documents WHERE n_chars >= 100")
def _(t):
    return t.documents.filter("n_chars >= 100").select("doc_id", "lang", "source")


@query("prj2_exclude_columns", "SELECT * EXCLUDE (text, n_chars) FROM documents")
def _(t):
    return t.documents.drop("text", "n_chars")


@query("prj4_struct_spread", "SELECT o_orderkey, 'late' AS o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 100000")
def _(t):
    # the right side wins: the override replaces the column of the same name
    return t.orders.filter("o_totalprice > 100000").select("o_orderkey", F.lit("late").alias("o_orderstatus"), "o_totalprice", "o_orderpriority")


@query("prj5_defaults", "SELECT event_id, coalesce(CASE WHEN value > 50 THEN event_type END, '') AS kind, coalesce(value, 0.0) AS value FROM events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.when(F.col("value") > 50, F.col("event_type")), F.lit("")).alias("kind"), F.coalesce("value", F.lit(0.0)).alias("value"))


@query("prj6_explode_words", "SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos, unnest(w) AS word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query("prj7_filtered_explode_join", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), v AS (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark) SELECT doc_id, item_id, count(*) AS n FROM (SELECT DISTINCT * FROM w WHERE length(word) >= 8) JOIN (SELECT DISTINCT * FROM v WHERE length(word) >= 8) USING (word) GROUP BY ALL")
def _(t):
    words = lambda d, k: d.select(k, F.explode(F.split("text", " ")).alias("word")).filter(F.length("word") >= 8).distinct()
    return words(t.documents, "doc_id").join(words(t.benchmark, "item_id"), "word").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


@query("prj8_nest_and_join", "SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn, text) AS joined FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(t):
    rows = t.conversations.filter("role = 'user'")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.btrim(s["text"])), " ").alias("joined"))


@query("prj9_pivot", "SELECT l_returnflag, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS BIGINT) AS q_o, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS BIGINT) AS q_f FROM lineitem GROUP BY 1")
def _(t):
    p = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity").cast("long"))
    return p.withColumnsRenamed({"O": "q_o", "F": "q_f"})


@query("prj10_cross_plan", "SELECT n_nationkey, lang, effort, row_number() OVER (ORDER BY n_nationkey, lang, effort) AS request_order FROM nation CROSS JOIN (VALUES ('en'), ('ko')) l(lang) CROSS JOIN (VALUES ('high'), ('low'), ('none')) e(effort)")
def _(t):
    # both dimensions are constants, so they explode in place and no join is made
    rows = t.nation.select("n_nationkey", F.explode(F.array(F.lit("en"), F.lit("ko"))).alias("lang")).select("*", F.explode(F.array(F.lit("high"), F.lit("low"), F.lit("none"))).alias("effort"))
    return op.numbered(rows, "n_nationkey", "lang", "effort", bucket=F.col("n_nationkey")).withColumnRenamed("number", "request_order")


@query("prj11_surrogate_ids", "SELECT conv_id, turn, 'F' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS VARCHAR), 3, '0') AS fact_id FROM conversations")
def _(t):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return t.conversations.select("conv_id", "turn", F.format_string("F%03d", n).alias("fact_id"))


@query("prj12_changed_fields", "SELECT c_custkey, 'c_mktsegment' AS field FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'c_acctbal' FROM customer WHERE c_acctbal < 0")
def _(t):
    before = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    after = before.withColumns({"c_mktsegment": F.when(F.col("c_mktsegment") == "BUILDING", "HOUSES").otherwise(F.col("c_mktsegment")), "c_acctbal": F.greatest("c_acctbal", F.lit(0.0))})
    return op.changed_fields(before, after, "c_custkey")


@query("prj14_blinding", "SELECT printf('PAIR_%04d', row_number() OVER (ORDER BY sha256('blind|' || doc_id), n_chars)) AS public_id, n_chars FROM documents")
def _(t):
    rows = t.documents.select("n_chars", op.hash_order("doc_id", "blind").alias("h"))
    return op.numbered(rows, "h", "n_chars").select(F.format_string("PAIR_%04d", "number").alias("public_id"), "n_chars")


@query("prj15_flatten_validated", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k IS NOT NULL")


@query("prj16_overlapping_children", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 3) GROUP BY 1")
def _(t):
    return t.lineitem.filter(F.col("l_linenumber").isin(1, 3)).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


# ---- filters


@query("flt1_in_between", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'")
def _(t):
    return t.orders.filter("o_orderstatus IN ('F', 'P') AND o_orderdate BETWEEN TIMESTAMP_NTZ '1994-01-01' AND TIMESTAMP_NTZ '1996-12-31'").select("o_orderkey", "o_orderstatus")


@query("flt2_regex_over_columns", "SELECT page_id FROM pages WHERE regexp_matches(coalesce(url, '') || ' ' || coalesce(html, ''), '(?i)casino|pills|the')")
def _(t):
    return t.pages.filter(F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).rlike("(?i)casino|pills|the")).select("page_id")


RULES_SQL = "list_filter([CASE WHEN NOT (n_chars >= 200) THEN 'too_short' END, CASE WHEN NOT (n_chars <= 8000) THEN 'too_long' END, CASE WHEN NOT (lang IN ('en', 'de')) THEN 'language_excluded' END, CASE WHEN contains(text, '@') THEN 'has_address' END], lambda x: x IS NOT NULL)"


def reasoned(t):
    d = t.documents
    rules = [("too_short", F.col("n_chars") >= 200), ("too_long", F.col("n_chars") <= 8000), ("language_excluded", F.col("lang").isin("en", "de")), ("has_address", ~F.contains("text", F.lit("@")))]
    return op.with_reasons(d, rules)


@query("flt3_reason_filter", f"SELECT doc_id, array_to_string({RULES_SQL}, ',') AS reasons, len({RULES_SQL}) = 0 AS eligible FROM documents")
def _(t):
    return reasoned(t).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "eligible")


@query("flt4_primary_reason", f"SELECT doc_id, CASE WHEN r LIKE '%too_%' THEN 'length' WHEN r LIKE '%language%' THEN 'language' WHEN r IS NOT NULL THEN 'other' END AS stage FROM (SELECT doc_id, ({RULES_SQL})[1] AS r FROM documents)")
def _(t):
    return reasoned(t).select("doc_id", op.primary_reason(F.col("reasons"), [("too_", "length"), ("language", "language")]).alias("stage"))


@query("flt5_tiered", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000 OR (s_nationkey < 10 AND s_acctbal > 0)")
def _(t):
    return t.supplier.filter("s_acctbal > 1000 OR (s_nationkey < 10 AND s_acctbal > 0)").select("s_suppkey")


@query("flt6_not_used_before", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("flt7_pending", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("flt8_retry", "SELECT d.doc_id, coalesce(CASE WHEN quality = 0 THEN 'retry' END, 'missing') AS why FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR quality = 0")
def _(t):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.filter("quality IS NULL OR quality = 0").select("doc_id", F.coalesce(F.when(F.col("quality") == 0, "retry"), F.lit("missing")).alias("why"))


@query("flt9_exists_forall", "SELECT doc_id, len(list_filter(w, lambda x: length(x) > 25)) > 0 AS some_long, len(w) > 0 AND len(list_filter(w, lambda x: length(x) <= 25)) = len(w) AS all_short FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def _(t):
    w = F.split("text", " ")
    return t.documents.select("doc_id", F.exists(w, lambda x: F.length(x) > 25).alias("some_long"), sc.all_and_some(w, lambda x: F.length(x) <= 25).alias("all_short"))


@query("flt10_first_signal", "SELECT page_id, CASE WHEN contains(url, 'casino') THEN 'gambling' WHEN contains(url, 'pills') THEN 'pharmacy' WHEN contains(url, 'ads') THEN 'ads' END AS why FROM pages")
def _(t):
    return t.pages.select("page_id", op.first_of([(F.contains("url", F.lit("casino")), "gambling"), (F.contains("url", F.lit("pills")), "pharmacy"), (F.contains("url", F.lit("ads")), "ads")]).alias("why"))


@query("flt11_label_guard", "SELECT doc_id, CASE WHEN toxic = 1 AND contains(text, 'idiot') AND NOT contains(text, 'clown') THEN 'guarded' END AS reason FROM documents JOIN labels USING (doc_id)")
def _(t):
    j = t.documents.join(t.labels, "doc_id")
    return j.select("doc_id", F.when((F.col("toxic") == 1) & F.contains("text", F.lit("idiot")) & ~F.contains("text", F.lit("clown")), "guarded").alias("reason"))


@query("flt12_trigger", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic = 1 OR contains(text, '@') OR len(regexp_extract_all(text, '[0-9]{16}')) > 0")
def _(t):
    j = t.documents.join(t.labels, "doc_id", "left")
    return j.filter((F.coalesce("toxic", F.lit(0)) == 1) | F.contains("text", F.lit("@")) | (F.size(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))) > 0)).select("doc_id")


@query("flt13_limit_per_origin", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 15")
def _(t):
    return op.top_per(t.documents.select("doc_id", "lang"), ["lang"], 15, F.col("doc_id")).drop("rank")


# ---- joins


@query("joi1_inner_three", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 150000")
def _(t):
    return t.orders.filter("o_totalprice > 150000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("joi2_left_with_status", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    l = t.labels.select("doc_id", F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("s"))
    return t.documents.select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit("missing")).alias("status"))


@query("joi3_key_gaps", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS only_in FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def _(t):
    return op.key_gaps(t.documents, t.labels, "doc_id")


@query("joi5_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def _(t):
    return t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("joi6_composite_key", "WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT a.user_id, a.event_type, a.n AS n_all, b.n AS n_high FROM e a JOIN (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL) b USING (user_id, event_type)")
def _(t):
    g = lambda d, n: d.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias(n))
    return g(t.events, "n_all").join(g(t.events.filter("value > 50"), "n_high"), ["user_id", "event_type"])


@query("joi7_paired_conditions", "SELECT user_id, round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS first, round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS second FROM events GROUP BY 1 HAVING first IS NOT NULL AND second IS NOT NULL")
def _(t):
    from ..operators.stats import paired

    return paired(t.events, ["user_id"], "event_type", "value", "click", "view").select("user_id", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


@query("joi8_registry", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_first, b.k IS NOT NULL AS in_second FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_tax > 0.07) b ON a.k = b.k")
def _(t):
    a = t.lineitem.filter("l_discount > 0.08").select(F.col("l_partkey").alias("k")).distinct().withColumn("a", F.lit(True))
    b = t.lineitem.filter("l_tax > 0.07").select(F.col("l_partkey").alias("k")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("a", F.lit(False)).alias("in_first"), F.coalesce("b", F.lit(False)).alias("in_second"))


@query("joi9_unique_links", "WITH a AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS v FROM documents), b AS (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS v FROM benchmark), u AS (SELECT v, min(item_id) AS item_id FROM b GROUP BY v HAVING count(*) = 1) SELECT doc_id, min(item_id) AS item_id FROM a JOIN u USING (v) GROUP BY doc_id")
def _(t):
    a = t.documents.select("doc_id", F.split("text", " ").alias("w"))
    return op.unique_links(a, t.benchmark.select("item_id", F.split("text", " ").alias("w")), "doc_id", "item_id", "w")


@query("joi10_override_precedence", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'override' END, c_mktsegment) AS segment FROM customer")
def _(t):
    changes = t.customer.filter("c_custkey % 7 = 0").select("c_custkey", F.lit("override").alias("new"))
    return t.customer.join(changes, "c_custkey", "left").select("c_custkey", F.coalesce("new", "c_mktsegment").alias("segment"))


@query("joi11_positional_zip", "WITH a AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer), b AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier) SELECT c_custkey, s_suppkey FROM a JOIN b USING (k, place)")
def _(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey")
    return op.positional_zip(a, t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey"), "k", "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")


@query("joi12_dimension", "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(t):
    # counts first: the dimensions meet one row per nation
    c = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "n")


@query("joi14_interval_overlap", "WITH s AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s FROM events) SELECT a.event_id AS a_id, b.event_id AS b_id FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.s + 3600 AND b.s < a.s + 3600")
def _(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), F.floor(at / 1000000).alias("start"))
    return op.overlaps(spans.withColumn("end", F.col("start") + 3600)).select("a_id", "b_id")


@query("joi16_hash_version", "SELECT d.doc_id, CASE WHEN md5(d.text) = md5(substr(d.text, 1, 1000)) THEN 'current' ELSE 'stale' END AS state FROM documents d")
def _(t):
    parent = t.documents.select("doc_id", F.md5("text").alias("h"))
    child = t.documents.select("doc_id", F.md5(F.substring("text", 1, 1000)).alias("g"))
    return parent.join(child, "doc_id").select("doc_id", F.when(F.col("h") == F.col("g"), "current").otherwise("stale").alias("state"))


@query("joi17_resolution", "SELECT o_orderkey, CASE WHEN x.l_orderkey IS NOT NULL THEN 'replaced' WHEN y.l_orderkey IS NOT NULL THEN 'retained' ELSE 'global' END AS how FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') x ON x.l_orderkey = o_orderkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A') y ON y.l_orderkey = o_orderkey")
def _(t):
    # one aggregation instead of two joins with the same table
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    return t.orders.select("o_orderkey").join(flags, "o_orderkey", "left").select("o_orderkey", F.when(F.col("r"), "replaced").when(F.col("a"), "retained").otherwise("global").alias("how"))


@query("joi18_guarded_overlay", "SELECT p_partkey, CASE WHEN p_size > 40 AND md5(p_name) < '8' THEN 'reviewed' ELSE p_brand END AS brand FROM part")
def _(t):
    reviewed = t.part.filter("p_size > 40").select("p_partkey", F.md5("p_name").alias("h")).filter("h < '8'")
    own = t.part.withColumn("h", F.md5("p_name"))
    return own.join(reviewed.withColumn("new", F.lit("reviewed")), ["p_partkey", "h"], "left").select("p_partkey", F.coalesce("new", "p_brand").alias("brand"))


# ---- aggregates


@query("agg1_counts_by_filter", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS n_discount, count(*) FILTER (WHERE l_tax = 0) AS n_untaxed, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1997-01-01') AS n_late FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_discount"), F.count_if(F.col("l_tax") == 0).alias("n_untaxed"), F.count_if(F.expr("l_shipdate >= TIMESTAMP_NTZ '1997-01-01'")).alias("n_late"))


@query("agg3_frequency_unknown", "SELECT coalesce(nullif(lang, 'fr'), 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.coalesce(F.nullif(F.col("lang"), F.lit("fr")), F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("agg4_element_frequency", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM benchmark) GROUP BY 1")
def _(t):
    return t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("agg5_two_way", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def _(t):
    return t.documents.groupingSets([[F.col("lang"), F.col("source")], [F.col("lang")], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("agg6_funnel", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_chars >= 200) AS long_enough, count(*) FILTER (WHERE n_chars >= 200 AND lang = 'en') AS english, count(*) FILTER (WHERE n_chars >= 200 AND lang = 'en' AND NOT contains(text, '@')) AS clean FROM documents")
def _(t):
    return op.funnel(t.documents, [("long_enough", F.col("n_chars") >= 200), ("english", F.col("lang") == "en"), ("clean", ~F.contains("text", F.lit("@")))])


@query("agg7_retention", "SELECT round(count(*) FILTER (WHERE n_chars >= 200) / count(*), 6) AS kept, coalesce(round(count(*) FILTER (WHERE n_chars >= 200 AND lang = 'zz') / nullif(count(*) FILTER (WHERE lang = 'zz'), 0), 6), 0) AS kept_zz FROM documents")
def _(t):
    long = F.col("n_chars") >= 200
    share = lambda a, b: F.coalesce(F.round(F.try_divide(F.count_if(a), F.count_if(b)), 6), F.lit(0.0))
    return t.documents.agg(share(long, F.lit(True)).alias("kept"), share(long & (F.col("lang") == "zz"), F.col("lang") == "zz").alias("kept_zz"))


@query("agg8_median", "SELECT lang, min(n_chars) AS least, CAST(quantile_cont(n_chars, 0.5) AS DOUBLE) AS middle, max(n_chars) AS most FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(F.min("n_chars").alias("least"), F.percentile("n_chars", F.lit(0.5)).alias("middle"), F.max("n_chars").alias("most"))


@query("agg9_mean_of_booleans", "SELECT source, round(avg(CAST(n_chars > 1000 AS INT)), 6) AS share FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.round(F.avg((F.col("n_chars") > 1000).cast("int")), 6).alias("share"))


@query("agg10_top_words", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def _(t):
    return t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(100)


@query("agg11_modal_first", "WITH g AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, n * 1000000000000 - f) AS mode, max(n) AS n_mode FROM g GROUP BY 1")
def _(t):
    return op.modal(t.events, ["user_id"], "event_type", "event_id")


@query("agg12_majority", "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type AS v FROM events), g AS (SELECT user_id, max(v) FILTER (WHERE k = 1) AS a, max(v) FILTER (WHERE k = 2) AS b, max(v) FILTER (WHERE k = 3) AS c FROM r GROUP BY 1) SELECT user_id, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS consensus, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'incomplete_replicates' WHEN a = b OR a = c OR b = c THEN 'agreed' ELSE 'replicate_disagreement' END AS status FROM g")
def _(t):
    r = t.events.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return op.majority_of_three(r.filter("k <= 3"), ["user_id"], "k", "event_type")


@query("agg13_distinct", "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents GROUP BY 1")
def _(t):
    # texts by hash: nothing long is shuffled
    return t.documents.select("lang", "source", F.md5("text").alias("h")).groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct("h").alias("texts"))


@query("agg14_max_severity", "SELECT o_custkey, arg_max(o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 2 ELSE 1 END) AS worst FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderpriority", -F.substring("o_orderpriority", 1, 1).cast("int")).alias("worst"))


@query("agg15_concat_arrays", "SELECT source, count(DISTINCT w) AS n_words FROM (SELECT source, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def _(t):
    # distinct words are counted as rows; no group's words meet in one array
    return t.documents.select("source", F.explode(F.split("text", " ")).alias("w")).groupBy("source").agg(F.count_distinct("w").alias("n_words"))


@query("agg16_status_rollup", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag IS NULL) THEN 'missing' WHEN bool_or(l_returnflag = 'R') THEN 'fail' WHEN bool_or(l_discount > 0.08) THEN 'warning' ELSE 'pass' END AS status FROM lineitem GROUP BY 1")
def _(t):
    any_ = lambda c: F.bool_or(c)
    return t.lineitem.groupBy("l_orderkey").agg(F.when(any_(F.col("l_returnflag").isNull()), "missing").when(any_(F.col("l_returnflag") == "R"), "fail").when(any_(F.col("l_discount") > 0.08), "warning").otherwise("pass").alias("status"))


@query("agg18_group_summary", "SELECT lang, CAST(NULL AS VARCHAR) AS source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang UNION ALL SELECT NULL, source, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY source UNION ALL SELECT NULL, NULL, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents")
def _(t):
    return t.documents.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("agg19_cost_cube", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("agg20_two_level", "SELECT round(avg(CAST(x AS INT)), 6) AS share FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS x FROM lineitem GROUP BY 1)")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("x")).agg(F.round(F.avg(F.col("x").cast("int")), 6).alias("share"))


@query("agg21_transitions", "WITH p AS (SELECT event_type AS y, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events), g AS (SELECT x, y, count(*) AS n FROM p WHERE x IS NOT NULL GROUP BY ALL), k(v) AS (VALUES ('click'), ('view'), ('purchase'), ('never')) SELECT a.v AS x, b.v AS y, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN g ON g.x = a.v AND g.y = b.v")
def _(t):
    from ..operators.stats import transitions

    pairs = t.events.select(F.col("event_type").alias("y"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("x"))
    return transitions(pairs.filter("x IS NOT NULL"), "x", "y", ["click", "view", "purchase", "never"])


@query("agg23_zero_is_null", "SELECT event_type, nullif(round(sum(coalesce(CASE WHEN value > 1e9 THEN value END, 0)), 2), 0) AS big FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.nullif(F.round(F.sum(F.coalesce(F.when(F.col("value") > 1e9, F.col("value")), F.lit(0.0))), 2), F.lit(0.0)).alias("big"))


# ---- windows, sorts, sets


@query("win1_ranked_sample", "SELECT c_custkey, c_nationkey, CAST(rank AS INT) AS rank FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('s1|' || c_custkey)) AS rank FROM customer) WHERE rank <= 3")
def _(t):
    return op.top_per(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], 3, op.hash_order("c_custkey", "s1"))


@query("win3_first_per_family", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('fam|' || doc_id)) = 1")
def _(t):
    return op.first_per(t.documents.select("doc_id", "source"), ["source"], op.hash_order("doc_id", "fam"))


@query("win4_ranks", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS request_order FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("request_order"))


@query("win5_round_robin", "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('rr|' || c_custkey)) AS turn FROM customer) ORDER BY turn, c_nationkey LIMIT 60")
def _(t):
    return op.round_robin(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", 60, op.hash_order("c_custkey", "rr")).drop("turn")


@query("win6_period_quota", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, year(o_orderdate) ORDER BY sha256('q|' || o_orderkey)) <= 5")
def _(t):
    return op.top_per(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus", F.year("o_orderdate")], 5, op.hash_order("o_orderkey", "q")).select("o_orderkey")


@query("win7_nearest_before", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w).alias("last_click"))


@query("win8_gap_ranges", "WITH d AS (SELECT DISTINCT doc_id FROM labels), g AS (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM d) SELECT min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM g GROUP BY g")
def _(t):
    # ids less their number are the same within an island; numbers come from counts per range of ids, not from one window
    d = t.labels.select("doc_id").distinct()
    d = op.numbered(d, "doc_id", bucket=F.floor(F.col("doc_id") / 4096))
    return d.groupBy((F.col("doc_id") - F.col("number")).alias("g")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).drop("g")


@query("win9_sliding_windows", "WITH w AS (SELECT doc_id, unnest(generate_series(0, CAST(length(text) AS BIGINT) - 1, 1800)) AS start, text FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, start, length(x) - length(replace(x, 'th', '')) AS score FROM (SELECT doc_id, start, substr(text, start + 1, 2200) AS x FROM w)) SELECT doc_id, start, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) <= 6")
def _(t):
    w = t.documents.filter(F.length("text") > 0).select("doc_id", F.explode(F.expr("sequence(0L, cast(length(text) - 1 as bigint), 1800L)")).alias("start"), "text")
    x = F.substring(F.col("text"), F.col("start").cast("int") + 1, F.lit(2200))
    s = w.select("doc_id", "start", (F.length(x) - F.length(F.replace(x, F.lit("th"), F.lit("")))).cast("long").alias("score"))
    return op.top_per(s, ["doc_id"], 6, F.desc("score"), F.col("start")).drop("rank")


@query("win10_neighbourhood", "SELECT conv_id, turn, max(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near_user FROM conversations")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-2, 2)
    return t.conversations.select("conv_id", "turn", F.max((F.col("role") == "user").cast("int")).over(w).alias("near_user"))


@query("srt1_mixed_sort", "SELECT c_custkey, c_acctbal, c_mktsegment = 'BUILDING' AS b FROM customer ORDER BY b DESC, c_acctbal, c_custkey")
def _(t):
    return t.customer.select("c_custkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").alias("b")).orderBy(F.desc("b"), "c_acctbal", "c_custkey")


@query("srt2_priority_then_longest", "SELECT conv_id, role, CAST(length(text) AS INT) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, length(text) DESC, text, turn) = 1")
def _(t):
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("p"), (-F.length("text")).alias("n"), "text", "turn", "role")).alias("m")
    return t.conversations.groupBy("conv_id").agg(best).select("conv_id", "m.role", (-F.col("m.n")).alias("n"))


@query("srt4_region_then_fill", "WITH s AS (SELECT n_name, n_regionkey, count(*) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY score DESC, n_name) AS r FROM s) SELECT n_name FROM f ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, score DESC, n_name LIMIT 8")
def _(t):
    s = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("score")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    r = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("score"), "n_name"))
    return s.withColumn("r", r).orderBy((F.col("r") != 1).cast("int"), F.desc("score"), "n_name").limit(8).select("n_name")


@query("srt5_argmax_priority", "SELECT o_custkey, arg_max(o_orderstatus, n * 10 - CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS status FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def _(t):
    g = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    p = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return g.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("n", -p)).alias("status"))


@query("set1_union_all", "SELECT n_name AS name, n_nationkey AS k FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
def _(t):
    return t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")).unionByName(t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


@query("set2_key_sets", "SELECT 'both' AS what, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def _(t):
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("what"), "k").unionByName(a.subtract(b).select(F.lit("only").alias("what"), "k"))


@query("set6_jaccard_distance", "WITH w AS (SELECT doc_id, list_distinct(string_split(lower(substr(text, 1, length(text) // 2)), ' ')) AS a, list_distinct(string_split(lower(substr(text, length(text) // 2 + 1)), ' ')) AS b FROM documents) SELECT doc_id, round(1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS distance FROM w")
def _(t):
    # the words of a text's halves
    half = (F.length("text") / 2).cast("int")
    a, b = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    halves = t.documents.select("doc_id", *[F.array_distinct(F.split(F.lower(x), " ")).alias(n) for n, x in (("a", a), ("b", b))])
    return halves.select("doc_id", F.round(sc.jaccard_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query("set3_subset", "WITH w AS (SELECT doc_id, list_distinct(string_split(substr(text, 1, length(text) // 2), ' ')) AS a, list_distinct(string_split(substr(text, length(text) // 2 + 1), ' ')) AS b FROM documents) SELECT doc_id, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS inside, list_sort(a) = list_sort(b) AS same FROM w")
def _(t):
    # whether the second half of a text has no word that the first lacks
    half = (F.length("text") / 2).cast("int")
    a, b = F.split(F.substring("text", F.lit(1), half), " "), F.split(F.substring("text", half + 1, F.length("text")), " ")
    halves = t.documents.select("doc_id", F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b"))
    return halves.select("doc_id", (F.size(F.array_except("b", "a")) == 0).alias("inside"), sc.same_set(F.col("a"), F.col("b")).alias("same"))