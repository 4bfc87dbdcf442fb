from pyspark.sql import functions as F

from lexstrata.functions import arrow
from lexstrata.operators import quality as qu


def test_arrow_functions(spark):
    assert arrow.json_part('x ```json\n{"a": [1, 2,], "b": "}"}\n``` y') == '{"a": [1, 2], "b": "}"}' and arrow.json_part("{bad") is None and arrow.json_part(None) is None
    assert arrow.metric("5 miles at 60 mph, 10-foot wall, 98.6 degrees Fahrenheit") == "8.0 km at 96.6 km/h, 3.0 m wall, 37.0 celsius"
    assert arrow.quantities("3.5미터와 2 kg") == ["2 kg", "3.5 m"] and arrow.quantities("１０ km") == ["10 km"]
    row = spark.createDataFrame([("ﬁ", ["The cat sat.", "A dog ran far."], "a dog ran")], "x string, s array<string>, w string")
    got = row.select(arrow.nfkc("x").alias("n"), arrow.casefold("x").alias("c"), arrow.best_sentence("s", "w").alias("b"), arrow.to_metric(F.lit("1 mile")).alias("m"), arrow.canonical_quantities(F.lit("1 km")).alias("q")).first()
    assert (got.n, got.c, got.b.sentence, got.m, got.q) == ("fi", "fi", "A dog ran far.", "1.6 km", ["1 km"])


def test_invariants_and_scales(spark):
    df = spark.createDataFrame([(1, "pass"), (1, "fail"), (2, "warning"), (2, "pass"), (3, "odd")], "k int, status string")
    rows = {r.invariant: r.holds for r in qu.invariants({"no_fail": df.filter("status = 'fail'"), "known": df.filter("k > 9")}).collect()}
    assert rows == {"no_fail": False, "known": True}
    assert {r.k: r.status for r in qu.worst(df, ["k"], "status", "status").collect()} == {1: "fail", 2: "warning", 3: "odd"}
    assert qu.single_valued(df, "k", ["status"]).filter("k = 3").first().one_status
    gate = qu.batch_gate(df, F.col("status") == "fail", F.lit(False), 0.1, 0.5).first()
    assert gate.blocked and gate.hard_rate == 0.2


def test_adjudication_reviews_and_changes(spark):
    df = spark.createDataFrame([(1, ["x"], "pass"), (2, [], "warning"), (3, [], None)], "k int, hard array<string>, model string")
    assert {r.k: (r.final, r.basis) for r in qu.adjudicated(df, "hard", "model").collect()} == {1: ("fail", "deterministic_override"), 2: ("warning", "model"), 3: ("missing", "missing")}
    reviews = spark.createDataFrame([("a", "h", "accept", None, None), ("b", "old", "edit", "n", ""), ("c", "h", "reject", "n", None), ("c", "h", "reject", "n", None)], "id string, parent_sha256 string, action string, notes string, text string")
    parents = spark.createDataFrame([("a", "h"), ("b", "h")], "id string, sha256 string")
    assert {r.id: r.errors for r in qu.review_errors(reviews, parents, "id").collect()} == {"b": ["stale_parent", "text_required"], "c": ["repeated", "unknown_parent"]}
    before = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "k int, x string, y string")
    after = spark.createDataFrame([(1, "z", "b"), (2, "a", "z")], "k int, x string, y string")
    assert [tuple(r) for r in qu.unexpected_changes(before, after, "k", {1: {"x"}}).collect()] == [(2, "y")]
    answer = spark.createDataFrame([("Facts: the plaintiff met the defendant. Issue: who pays. Rule: none. Result: both pay 5.",)], "t string")
    checks = qu.response_checks(F.col("t"), "en", F.array(F.lit("5")), F.array(F.lit("5")), ["facts", "issue", "rule", "result"])
    assert answer.select(qu.failed_checks(checks).alias("f")).first().f == []
