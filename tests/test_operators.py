"""Operators on hand-made rows: allocation, lexicon, segments, graphs, statistics and order invariance."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexstrata.operators import allocation as al
from lexstrata.operators import graph, lexicon, segments, stats
from lexstrata.operators import rows as op


def test_max_flow():
    edges = {("S", "a"): 19, **{("S", x): 20 for x in "bcde"}, **{(x, "T"): 20 for x in "abcde"}}
    assert al.max_flow(edges, "S", "T")[0] == 99
    assert al.max_flow({("S", "a"): 3, ("a", "b"): 2, ("b", "T"): 5, ("a", "T"): 2}, "S", "T")[0] == 3
    assert al.max_flow({}, "S", "T") == (0, {})


def test_bounded_allocation():
    available = {(s, d): 6 for s in "ABCDE" for d in ("x", "y")}
    got = al.bounded_allocation(available, {"x": 25, "y": 25}, 10, 12)
    assert got and all(sum(n for (s, _), n in got.items() if s == t) == 10 for t in "ABCDE")
    assert sum(n for (_, d), n in got.items() if d == "x") == 25
    available[("A", "x")], available[("A", "y")] = 5, 4
    assert al.bounded_allocation(available, {"x": 25, "y": 25}, 10, 12) is None


def test_rosters_and_apportionment(spark):
    rng = random.Random(3)
    rows = [{"id": f"c{i:02d}", "family": f"f{rng.randint(0, 7)}", "domain": rng.choice("xy"), "current": rng.random() < 0.4, "cost": rng.randint(0, 9)} for i in range(12)]
    want = None
    for pick in itertools.combinations(rows, 4):
        if len({p["family"] for p in pick}) == 4 and 1 <= sum(p["domain"] == "x" for p in pick) <= 2 and 1 <= sum(p["domain"] == "y" for p in pick) <= 3:
            score = (sum(p["current"] for p in pick), -sum(p["cost"] for p in pick))
            want = max(want, score) if want else score
    got = al.minimum_change_roster(rows, 4, {"x": (1, 2), "y": (1, 3)})
    pick = [r for r in rows if r["id"] in got]
    assert (sum(p["current"] for p in pick), -sum(p["cost"] for p in pick)) == want
    assert al.minimum_change_roster(rows, 4, {"x": (9, 9), "y": (0, 4)}) is None
    assert al.ranked_allocations({"a": (1, 3), "b": (0, 4)}, 4)[0] == {"a": 2, "b": 2}
    assert [al.minimum_target(n) for n in (0, 1, 4, 10)] == [2, 3, 6, 15]
    assert al.greedy_diverse([{"id": 1, "score": 2, "k": "a"}, {"id": 2, "score": 2, "k": "a"}, {"id": 3, "score": 1.8, "k": "b"}], 2, {"k": 1.0}) == [1, 3]
    seats = op.largest_remainder(spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "g string, n int"), "g", "n", 7)
    assert {r.g: r.seats for r in seats.collect()} == {"a": 4, "b": 2, "c": 1} or {r.g: r.seats for r in seats.collect()} == {"a": 3, "b": 2, "c": 2}


FORMS = [
    {"surface_id": "1", "concept_id": "duty", "category": "doctrine", "family": "d", "scope": "us", "form": "duty of care"},
    {"surface_id": "2", "concept_id": "care", "category": "doctrine", "family": "c", "scope": "us", "form": "care"},
    {"surface_id": "3", "concept_id": "comp", "category": "remedy", "family": "r", "scope": "us", "form": "compensatory damages"},
    {"surface_id": "4", "concept_id": "dam", "category": "doctrine", "family": "x", "scope": "us", "form": "damages"},
    {"surface_id": "5", "concept_id": "dam2", "category": "doctrine", "family": "x", "scope": "us", "form": "damages"},
    {"surface_id": "6", "concept_id": "dam3", "category": "remedy", "family": "y", "scope": "kr", "form": "damages"},
    {"surface_id": "7", "concept_id": "ko", "category": "remedy", "family": "k", "scope": "kr", "form": "손해 배상", "language": "ko"},
]


def test_lexicon(spark):
    docs = spark.createDataFrame([(1, "The Duty  of\ncare; carefully: compensatory damages"), (2, "그 손해  배상금"), (3, None), (4, "damages")], "doc_id long, text string")
    found = lexicon.hits(docs, FORMS)
    assert sorted((r.doc_id, r.concept_id, r.start, r.end) for r in found.collect() if r.doc_id != 4) == [(1, "care", 13, 17), (1, "comp", 30, 50), (1, "dam", 43, 50), (1, "dam2", 43, 50), (1, "dam3", 43, 50), (1, "duty", 4, 17), (2, "ko", 2, 8)]
    spans = lexicon.longest(lexicon.resolved(found), {"remedy": "doctrine"}).collect()
    assert sorted((r.doc_id, r.category, r.concept) for r in spans) == [(1, "doctrine", "duty"), (1, "remedy", "comp"), (2, "remedy", "ko"), (4, "remedy", "dam3")]
    only = lexicon.resolved(found.filter("doc_id = 4 AND category = 'doctrine'")).first()
    assert only.concept == "SHARED::dam|dam2"


def test_segments(spark):
    text = "One here.  Two there!\n\nThree\n  four? five"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "word " * 900)], "doc_id long, text string")
    s = segments.segments(docs)
    got = {r.doc_id: r.segments for r in s.collect()}
    assert [x.text for x in got[1]] == ["One here.", "Two there!", "Three\n  four?", "five"] and all(text[x.start : x.end] == x.text for x in got[1])
    assert got[2] == []
    c = [tuple(r)[1:4] for r in segments.chunks(s.filter("doc_id = 1"), 8, 1).orderBy("chunk").collect()]
    assert c[0] == (1, 1, 2) and c[-1][2] == 4 and {k for _, a, b in c for k in range(a, b + 1)} == {1, 2, 3, 4}
    assert [r.id for r in segments.near(s, "five", 1).collect()] == ["SRC0003", "SRC0004"]
    p = segments.passages(docs).collect()
    assert [(r.start, r.end) for r in p if r.doc_id == 1] == [(0, len(text))] and sum(r.end - r.start for r in p if r.doc_id == 3) == 4500
    m = spark.createDataFrame([("a b c d e f g h i j", "x a b c d e f g h y")], "p string, q string").select(segments.shared_runs(F.col("p"), F.col("q")).alias("m"))
    assert tuple(m.first().m) == (8, 1, 0, 0.8)


def test_graph(spark):
    e = spark.createDataFrame([(1, "x1", "person", "Kim", 5), (1, "x2", "person", "Lee", 2), (1, "x3", "company", "Acme", 9), (1, "x4", "person", "KIM", 7)], "case_id int, entity_id string, kind string, name string, position int")
    named = graph.named_entities(e)
    assert {r.old_id: r.placeholder for r in named.collect()} == {"x2": "[PERSON_A]", "x1": "[PERSON_B]", "x4": "[PERSON_B]", "x3": "[COMPANY_A]"}
    r = spark.createDataFrame([(1, "x1", "employed_by", "x3", False), (1, "x3", "employs", "x4", True), (1, "x1", "knows", "x4", True), (1, "x1", "knows", "gone", True)], "case_id int, subject string, relation string, object string, material boolean")
    assert [tuple(x) for x in graph.normal_relations(r, named).select("subject", "relation", "object", "material").collect()] == [("E003", "employs", "E002", True)]
    units = spark.createDataFrame([(1, ["x1", "zz"]), (1, ["yy"])], "case_id int, ids array<string>")
    assert graph.dangling(units, e, "case_id", "ids", "entity_id").first().missing == ["yy", "zz"]


def test_entities_of_one_name_equal_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    at = f"{tmp_path}/customer.parquet"
    rows = "SELECT i AS c_custkey, 'Customer#' || i % 20 AS c_name, CAST(i % 2 AS INT) AS c_nationkey, CAST(i AS DOUBLE) AS c_acctbal, CASE i % 3 WHEN 0 THEN 'a' ELSE 'b' END AS c_mktsegment FROM range(200) t(i)"
    db = duckdb.connect()
    db.execute(f"COPY ({rows}) TO '{at}' (FORMAT parquet)")
    db.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{at}')")
    want = db.execute(f"SELECT case_id, old_id, entity_id, placeholder FROM ({entry.oracle_sql()['gph1_entities']})").fetchall()
    got = entry.queries()["gph1_entities"](spark, str(tmp_path)).select("case_id", "old_id", "entity_id", "placeholder").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == 200


def test_entities_beyond_two_letters_equal_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    at = f"{tmp_path}/customer.parquet"
    rows = "SELECT i AS c_custkey, 'Customer#' || i AS c_name, 1 AS c_nationkey, CAST(i AS DOUBLE) AS c_acctbal, 'a' AS c_mktsegment FROM range(1500) t(i)"
    odd = "SELECT * FROM (VALUES (7, 'Customer#7', 1, 7.0, 'a'), (NULL, 'x', 2, 0.0, 'a'), (NULL, NULL, 2, 0.0, 'b'), (1, 'y', 2, 0.0, NULL), (NULL, 'z', NULL, 0.0, 'a'), (2, 'z', NULL, 0.0, 'a'))"
    db = duckdb.connect()
    db.execute(f"COPY ({rows} UNION ALL {odd}) TO '{at}' (FORMAT parquet)")
    db.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{at}')")
    want = db.execute(f"SELECT case_id, old_id, entity_id, placeholder FROM ({entry.oracle_sql()['gph1_entities']})").fetchall()
    got = entry.queries()["gph1_entities"](spark, str(tmp_path)).select("case_id", "old_id", "entity_id", "placeholder").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr) and len(want) == 1506


def test_entity_letters_at_every_code_point(spark):
    from lexstrata.plans.library import _two_letters

    points = [64 + 27, 255, 256, 0xD7FF, 0xE000, 0xFEFF, 0xFFFF, 0x10000, 0x10FFFF]
    ks = [(p - 64) * 26 + 2 for p in points]
    got = [r.v for r in spark.createDataFrame([(k,) for k in [1, 26, 27, 702, *ks, (0xD800 - 64) * 26 + 1]], "k int").select(_two_letters("k").alias("v")).collect()]
    assert got[:-1] == ["A", "Z", "AA", "ZZ", *(chr(p) + "B" for p in points)]
    assert got[-1].isalpha() and got[-1].isascii() and len(got[-1]) > 2


def test_statistics(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 40), rng.integers(2, 12, 30)
    df = spark.createDataFrame([("a", int(v)) for v in a] + [("b", int(v)) for v in b], "g string, v int")
    r = stats.rank_counts(df, "g", "v", "a", "b").first()
    delta = (np.sign(a[:, None] - b[None, :])).mean()
    assert r.cliffs_delta == pytest.approx(delta) and r.u == pytest.approx((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum())
    assert stats.mcnemar(0, 0) == 1 and stats.mcnemar(1, 9) == pytest.approx(2 * 11 / 1024) and 0 < stats.mcnemar(900, 1100) < 1e-4
    tests = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "k string, p double")
    assert {r.k: round(r.adjusted, 6) for r in stats.benjamini_hochberg(tests, "p", "k").collect()} == {"x": 0.03, "y": 0.04, "z": 0.04}
    same = spark.createDataFrame([("a", "a")] * 20 + [("a", "b")] * 5 + [("b", "a")] * 10 + [("b", "b")] * 15, "x string, y string")
    assert stats.kappa(same, "x", "y").first().kappa == pytest.approx(0.4)
    ci = stats.bootstrap_mean(df.withColumn("k", F.monotonically_increasing_id()), "v", "k").first()
    assert ci.low < np.concatenate([a, b]).mean() < ci.high
    d = spark.createDataFrame([(i, 1.0 + 0.1 * (i % 3)) for i in range(20)], "k long, d double")
    assert stats.sign_flip(d, "d", "k", 400).first().p == pytest.approx(1 / 401)


def test_dispersion_of_rings(spark):
    rows = [(i, g, r * math.cos(2 * math.pi * i / 24), r * math.sin(2 * math.pi * i / 24)) for g, r in (("a", 3.0), ("b", 1.0)) for i in range(24)]
    df = spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(rows)], "k long, g string, x double, y double")
    means = {r.g: r.mean_distance for r in stats.dispersion(df, "g", ["x", "y"]).collect()}
    assert means["a"] - means["b"] == pytest.approx(2.0) and means["a"] / means["b"] == pytest.approx(3.0)
    assert stats.dispersion_test(df, "g", ["x", "y"], "k", 150).first().p <= 0.01
    pc = stats.principal(df.withColumn("z", F.col("x") * 2), ["x", "z"], 1).collect()
    assert np.corrcoef([r.pc1 for r in pc], [r.x for r in pc])[0, 1] == pytest.approx(1)


def test_consensus_is_order_invariant(spark):
    rows = [(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (2, 1, "A"), (2, 2, "B"), (2, 3, "C"), (3, 1, "A"), (4, 1, "B"), (4, 2, "A"), (4, 3, "A")]
    want = {(1, "A", "agreed"), (2, None, "replicate_disagreement"), (3, None, "incomplete_replicates"), (4, "A", "agreed")}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, r int, v string").repartition(3 + seed)
        assert {tuple(x) for x in op.majority_of_three(df, ["k"], "r", "v").collect()} == want
