"""URL filter: rules first, then a path-template tree per host, in DataFrame functions only.

Segments that vary by form become wildcards: `{n}` for digits, `{h}` for hexadecimal runs and `{id}` for runs that mix
letters and digits, a file's ending kept. Then, level by level, a host's node with many rarely seen children gets one
wildcard child `*`, and labelled children whose labelled shares can't be told apart from their siblings' (a
two-proportion test below Z) merge into `+`. Levels from DEPTH on share one tail. Labels come from the rules: a page
that a rule decides is labelled by it. A template is rejected if its labelled purity, smoothed by ALPHA rows of
one half, reaches PURITY; one without labels is kept.

Rows meet their node's statistics by joins salted SALT-fold, so that a host with a third of all rows is dealt out.

Edge cases: a url that is null or has no `://` has an empty host and path and its own (empty) template; repeated urls
are judged alike; page_id may be null or repeat; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, written

#: (verdict, host and path); the longest rule that fits wins, then the first.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
DEPTH, KIDS, SUPPORT, Z, ALPHA, PURITY, SALT = 3, 16, 4, 1.64, 2.0, 0.8, 16


def split_url(url: str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty where there is no `://`."""
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The rule that decides columns host and path, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, r in sorted(reversed(rules), key=lambda x: len(x[1])):
        host, slash, path = r.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def form(segment: Column) -> Column:
    """The segment with its variable part as a wildcard."""
    out = segment
    for pattern, mark in ((r"^[0-9]+(\.[a-z]{2,5})?$", "{n}$1"), (r"^[0-9a-f]{8}[0-9a-f-]{8,}(\.[a-z]{2,5})?$", "{h}$1"), (r"^(?=[^.]*[0-9])(?=[^.]*[A-Za-z])[A-Za-z0-9_-]{10,}(\.[a-z]{2,5})?$", "{id}$1")):
        out = F.regexp_replace(out, pattern, mark)
    return out


def salted(rows: DataFrame, nodes: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Inner join of rows with their nodes (few, one per key), dealt by key and salt."""
    many = nodes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int")).join(many, [*on, "__salt"]).drop("__salt")


def generalised(paths: DataFrame, level: int) -> DataFrame:
    """paths with column t<level>: the tree's branch at this level. Columns host, t0.., s<level>, n, bad, good are there."""
    node, s, t = ["host", *[f"t{i}" for i in range(level)]], f"s{level}", f"t{level}"
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    kids = paths.groupBy(*node, s).agg(*sums)
    whole = kids.groupBy(*node).agg(F.count(F.lit(1)).alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good")])
    seen, others = F.col("bad") + F.col("good"), F.col("all_bad") + F.col("all_good") - F.col("bad") - F.col("good")
    share = (F.col("all_bad")) / F.greatest(F.col("all_bad") + F.col("all_good"), F.lit(1))
    spread = F.sqrt(share * (1 - share) * (1 / F.greatest(seen, F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
    apart = F.abs(F.col("bad") / F.greatest(seen, F.lit(1)) - (F.col("all_bad") - F.col("bad")) / F.greatest(others, F.lit(1)))
    branch = (
        F.when(F.col(s) == "", "")
        .when((F.col("kids") >= KIDS) & (F.col("all_n") < F.col("kids") * SUPPORT), "*")
        .when((seen > 0) & (others > 0) & (apart <= Z * spread), "+")
        .otherwise(F.col(s))
    )
    named = salted(kids, whole, node, [s]).select(*node, s, branch.alias(t))
    return salted(paths, named, [*node, s], ["tail", *[f"s{i}" for i in range(DEPTH)]])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = split_url("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), form)
    rows = rows.withColumn("__segments", segments)
    rows = rows.withColumns({**{f"s{i}": F.coalesce(F.get("__segments", F.lit(i)), F.lit("")) for i in range(DEPTH)}, "tail": F.array_join(F.slice("__segments", DEPTH + 1, 1 << 30), "/")}).drop("__segments")
    key = ["host", *[f"s{i}" for i in range(DEPTH)], "tail"]
    paths = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"), F.count_if(F.col("ruled") == "allow").alias("good"))
    paths = written(paths, "paths")  # else each level would double the plan
    for level in range(DEPTH):
        paths = written(generalised(paths, level), "paths")
    template = ["host", *[f"t{i}" for i in range(DEPTH)]]
    purity = (F.sum("bad") + ALPHA / 2) / (F.sum("bad") + F.sum("good") + ALPHA)
    judged = salted(paths.select(*key, *template[1:]), paths.groupBy(*template).agg(purity.alias("purity")), template, key)
    t = F.concat(F.col("host"), *[F.when(F.col(f"t{i}") != "", F.concat(F.lit("/"), F.col(f"t{i}"))).otherwise("") for i in range(DEPTH)])
    final = salted(rows, judged.select(*key, t.alias("template"), "purity"), key, ["page_id", "path"])
    method = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return final.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
