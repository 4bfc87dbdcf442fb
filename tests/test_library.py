"""Operators that no SQL can say, against brute force on small rows."""

import itertools
import random
import re
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexstrata.functions import fixed_labels as L
from lexstrata.functions import matching
from lexstrata.functions import scalars as sc
from lexstrata.functions import text as tx
from lexstrata.operators import dedup, labels, quality, rules, segments, stats
from lexstrata.operators import rows as op
from lexstrata.plans.labels import ENGLISH, KOREAN
from lexstrata.sources import files


def some(t, patterns):
    return any(re.search(p, t, re.I) for p in patterns)


def test_korean_sufficiency_equals_python(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.sample(KOREAN, k)) * rng.choice([1, 3]) for k in (1, 3, 6, 9, 12) for _ in range(8)] + ["", "기초사실 " + "원고는 피고와 사고 당시 도로에서 충돌하였고 그 결과 사망하였다. 피고는 책임이 없다고 주장한다. " * 12 + "판단"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r.i: r.f for r in df.select("i", labels.facts_ko("x").alias("f")).collect()}
    for i, t in enumerate(texts):
        has = [n for n, p in L.FACTS_KO if some(t[:12000], p)]
        m = re.search(L.FACT_SECTION_KO, t)
        section = len(m.group(1)) if m else 0
        score = min(100, len(has) * 13 + (9 if section >= 500 else 0))
        taken, enough = some(t, L.INCORPORATED_KO), len(has) >= 6 and score >= 78
        if taken and section < 500:
            want = ("mostly_incorporated", False)
        elif taken:
            want = ("partially_incorporated", enough)
        elif (section >= 180 or len(t) >= 500 and len(has) == 7) and enough:
            want = ("self_contained", True)
        else:
            want = ("insufficient", False)
        assert (got[i].score, got[i].quality, got[i].independent) == (score, *want)
        assert got[i].missing == [n for n, _ in L.FACTS_KO if n not in has]


def test_governing_law_and_district(spark):
    row = spark.createDataFrame([("Under Ohio law and the law of California. Civil Code section 1.", "Second Appellate District, Division Three", "x CA4/2")], "x string, m string, n string")
    r = row.select(labels.governing_law("x", F.lit("california_state"), F.lit("high"), F.lit("unclear")).alias("g"), labels.district("m", "x").alias("d"), labels.district("n", "x").alias("e")).first()
    assert (r.g.law, r.g.other_state) == ("federal_or_other_law", True)
    assert tuple(r.d) == ("Second Appellate District", "Division Three") and tuple(r.e) == ("Fourth Appellate District", "Division 2")


@pytest.mark.parametrize("a, b, errors", [
    ("[PERSON_A]는 3명을 보았다.", "[PERSON_A] saw 4 men.", {"numerical_value_changed"}),
    ("그는 사망하였다.", "He was fine.", {"independent_fact_added_or_omitted"}),
    ("그는 알고 있었다.", "He did not know.", {"clear_polarity_reversal"}),
    ("[PERSON_A]가 왔다.", "[PERSON_B] came.", {"placeholder_identity_mismatch"}),
    ("그는 집에 왔다.", "He came home.", set()),
])
def test_translated_facts(spark, a, b, errors):
    f = spark.createDataFrame([(a, b)], "a string, b string").select(labels.translated_fact("a", "b", "ko").alias("f")).first().f
    assert set(f.errors) == errors


def test_residue(spark):
    r = spark.createDataFrame([("그는 [PERSON_A]와 the 5 km를 ABC 걸었다 Walking",)], "x string").select(labels.residue("x", "ko").alias("v")).first().v
    assert r == ["Walking", "the"]


def test_repeated_sentences_equal_python(spark):
    rng = random.Random(6)
    parts = ["This sentence is long enough.", "Another long sentence here!", "short.", "He paid 5. 000 in all of it.", "this sentence is  long enough."]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", "\n\n"]) for _ in range(rng.randint(0, 9))) for _ in range(40)] + [None]

    def want(t):
        own = [re.sub(r"\s+", " ", s).strip().lower() for s in re.split(r"(?<=[.!?])\s+(?!\d)|\n+", t or "")]
        return sorted({s for s in own if len(s) >= 15 and own.count(s) > 1})

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", rules.repeated_sentences("x").alias("r")).collect()
    assert all(r.r == want(texts[r.i]) for r in rows)


def test_segments_equal_walk(spark):
    rng = random.Random(9)
    bits = ["One. ", "Two!", "  ", "\n", "\n\n", "\r\n\r\n", "three", "？", "네。 ", "\t", "e.g. ", "\x1f", "é?\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(80)] + [None, "", "x" * 50_000 + ". y"]
    boundary = re.compile(r"(?<=[.!?。！？])(?:[ \t]+|\r?\n+)|\r?\n{2,}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in segments.segments(df).collect():
        t, at, want = texts[r.doc_id] or "", 0, []
        for m in [*boundary.finditer(t), None]:
            piece = t[at : m.start()] if m else t[at:]
            if piece.strip():
                left = at + len(piece) - len(piece.lstrip())
                want.append((f"SRC{len(want) + 1:04d}", piece.strip(), left, left + len(piece.strip())))
            at = m.end() if m else at
        assert [tuple(s) for s in r.segments] == want


def test_similar_texts_reach_texts_that_are_unlike_the_leader(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    other = base[:300] + "".join(rng.choice("ijklmnop ") for _ in range(100))
    rows = [(0, base), (1, other), (2, other[:-1]), (3, base + "q"), (4, None), (5, other)]
    got = {(r.a, r.b) for r in dedup.similar_texts(spark.createDataFrame(rows, "row long, text string"), "row", "text").collect()}
    like = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.96
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and like(x, y)}
    assert got <= want and {b for _, b in want} <= {b for _, b in got}


def test_similar_texts_list_every_link_between_different_texts(spark):
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    rows = [(100 + i, prose(rng.randint(0, 30))) for i in range(15)] + [(200, None), (201, ""), (202, "  ")]
    for k, n in enumerate([60, 300, 700, 900, 1500]):  # both sides of the lengths at which more cells count
        base = prose(n)
        for i in range(8):
            t = list(base)
            for _ in range(rng.randint(0, n // 30)):
                t[rng.randrange(n)] = rng.choice("xyz")
            rows.append((1000 * k + 300 + i, "".join(t)[: n - rng.randint(0, n // 40)]))
        rows += [(1000 * k + 400 + i, base.upper() + "!" * i) for i in range(3)]
    norm = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    like = lambda x, y: min(len(x), len(y)) > 0.9 * max(len(x), len(y)) and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.96
    least, want = {}, set()
    for r, t in sorted(rows, key=lambda x: x[0]):
        if (first := least.setdefault(norm(t), r)) != r:
            want.add((first, r))
    want |= {(a, b) for (x, a), (y, b) in itertools.combinations(least.items(), 2) if like(x, y)}
    got = [(r.a, r.b) for r in dedup.similar_texts(spark.createDataFrame(rows, "row long, text string").repartition(5), "row", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_similar_texts_are_judged_by_their_whole_length(spark):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    start = prose(6000)
    changed = list(prose(40_000))
    late = "".join(changed)
    for i in range(0, 4000, 14):
        changed[i] = "x"
    rows = [(1, start + prose(6000)), (2, start + prose(6000)), (3, late), (4, "".join(changed)), (5, start), (6, start + prose(400))]
    got = {r.a: (r.b, r.ratio) for r in dedup.similar_texts(spark.createDataFrame(rows, "row long, text string"), "row", "text").collect()}
    assert got.keys() == {3, 5} and got[3][0] == 4 and got[5][0] == 6
    assert got[3][1] == pytest.approx(1 - 286 / 40_000, abs=1e-3) and got[5][1] == pytest.approx(12_000 / 12_400, abs=1e-3)


@pytest.mark.parametrize("small", [0, 1 << 14])
def test_ratio_of_long_texts_equals_difflib(monkeypatch, small):
    monkeypatch.setattr(matching, "SMALL", small)
    rng = random.Random(6)
    mixed = ["a"]
    for _ in range(11):
        mixed.append(mixed[-1] + mixed[-1].translate(str.maketrans("ab", "ba")))
    pairs = [("", ""), ("", "a"), (mixed[-1], mixed[-1][::-1]), (mixed[-1] + "c", mixed[-1].translate(str.maketrans("ab", "ba")) + "c")]  # hashes modulo 2^64 mistake these for each other
    for n in (1, 9, 80, 700):
        for signs in ("a", "ab", "abcdefgh ", "é😀x"):
            for k in (0, 2, 30):
                x = [rng.choice(signs) for _ in range(n)]
                y = x[n // 3 :] + x[: n // 3] if k == 2 else x[:]
                for _ in range(k):
                    y[rng.randrange(n)] = rng.choice("abx")
                pairs.append(("".join(x), "".join(y) + "b" * (k // 9)))
    for x, y in pairs:
        want = SequenceMatcher(None, x, y, autojunk=False).ratio()
        assert [matching.ratio(x, y, least) for least in (0.0, want, 0.96)] == [want, want, want if want >= 0.96 else 0.0]


def test_unlike_texts_of_one_band_never_reach_difflib():
    rng = random.Random(4)
    texts = ["the same words open it " + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(300, 320))) for _ in range(300)]
    signed = pd.concat(dedup._signed([pd.DataFrame({"r": range(301), "t": [*texts, texts[0][:-3]]})]))
    assert dedup._meet(0.96)(signed.assign(key=7)).apply(set, axis=1).tolist() == [{0, 300}]


def test_small_functions(spark):
    one = spark.createDataFrame([(1,)], "x int")
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(sc.first_seen(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit(None), F.lit("b")))) == ["b", "a"]
    assert value(sc.let({"a": F.lit(2), "b": F.lit(3)}, lambda h: h["a"] * h["b"])) == 6
    assert value(sc.inverted(F.create_map(F.lit("p"), F.lit(1), F.lit("q"), F.lit(2), F.lit("r"), F.lit(1)))) == {2: "q", 1: "r"}
    assert [value(tx.alpha_suffix(F.lit(n))) for n in (1, 26, 27, 702, 703, 18278, 18279)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA"]
    assert value(tx.incident_fingerprint(F.lit("too short 2010. 03. 04."), F.lit("2010-03-04"), F.lit("k"))) is None
    assert value(F.size(tx.shingles(F.split(F.lit("a b c d"), " "), 5))) == 0
    assert value(F.size(tx.shingles(F.split(F.lit("a b c d e f"), " "), 5))) == 2


def test_numbers_without_a_global_window(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "v long")
    got = sorted((r.number, r.v) for r in op.numbered(df, "v", bucket=F.floor(F.col("v") / 1000)).collect())
    assert [n for n, _ in got] == list(range(1, 3001)) and [v for _, v in got] == sorted(v for v, in rows)


def test_samples_with_fallback_and_shortages(spark):
    rows = [(i, "ab"[i % 2], i % 3, i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, g string, p int, primary boolean")
    got = op.with_fallback(df, F.col("primary"), "g", "p", "k", {"a": 8, "b": 8}, 20, "s").collect()
    assert len(got) == 20 and sum(r.source == "primary" for r in got) == 12 and len({r.k for r in got}) == 20
    short = {r.g: (r.selected, r.shortage) for r in op.shortages(spark.createDataFrame(got), df, "g", {"a": 8, "b": 8, "c": 2}).collect()}
    assert short["c"] == (0, 2) and sum(n for n, _ in short.values()) == 20


def test_bootstrap_and_sign_flip(spark):
    rng = random.Random(5)
    values = [rng.gauss(10, 2) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double").repartition(7)
    r = stats.bootstrap_mean(df, "v", "k", 300).first()
    mean, half = sum(values) / 2000, 1.96 * 2 / 2000**0.5
    assert r.replicates == 300 and abs(r.low - (mean - half)) < 0.03 and abs(r.high - (mean + half)) < 0.03
    assert stats.bootstrap_mean(df.coalesce(1), "v", "k", 300).first().low == pytest.approx(r.low)
    assert stats.sign_flip(df, "v", "k").first().p == pytest.approx(1 / 501)
    even = spark.createDataFrame([(i, (-1.0) ** i) for i in range(100)], "k long, v double")
    assert stats.sign_flip(even, "v", "k").first().p == 1.0


def test_run_checks_find_changes(spark):
    base = spark.createDataFrame([(1, "ko", "h"), (1, "en", "h"), (2, "ko", "g")], "case_id int, language string, fact_sha256 string")
    plan = base.selectExpr("*", "'KR' target", "'i' instruction", "'i' wanted_instruction", "'p' prompt_before", "'i p' prompt_after")
    got = {r.check: r.holds for r in quality.run_checks(base, base.selectExpr("case_id", "'fr' language"), plan, {"seed": (1, 2)}).collect()}
    assert got == {"settings_unchanged": False, "exact_instructions": True, "each_case_has_both_languages": False, "languages_share_the_target": True, "case_selection_matches": True, "facts_unchanged": True, "only_the_prefix_differs": False, "answers_are_planned": False}


def test_arrow_files_revisions_and_quotas(spark, tmp_path):
    for k in range(2):
        with pa.OSFile(str(tmp_path / f"{k}.arrow"), "wb") as f, (pa.ipc.new_file if k else pa.ipc.new_stream)(f, pa.schema([("a", pa.int64()), ("b", pa.string())])) as w:
            w.write_batch(pa.record_batch([pa.array([k, None]), pa.array(["x", "y"])], names=["a", "b"]))
    rows = files.read_arrow(spark, [f"file://{tmp_path}/0.arrow", f"file://{tmp_path}/1.arrow"]).collect()
    assert sorted((r.a is None, r.a or 0, r.b) for r in rows) == [(False, 0, "x"), (False, 1, "x"), (True, 0, "y"), (True, 0, "y")]
    assert files.revision("ref: refs/heads/m\n", {"refs/heads/m": "abc\n"}, "") == "abc"
    assert files.revision("ref: refs/heads/m\n", {}, "# c\nfff refs/heads/m\n^x") == "fff" and files.revision("123\n", {}, "") == "123"
    (tmp_path / "q.json").write_text('{"quotas": {"a": 1}, "target_count": 3}')
    with pytest.raises(ValueError):
        files.read_quotas(spark, f"file://{tmp_path}/q.json")


def test_phrases_reach_every_label(spark):
    df = spark.createDataFrame([(t,) for t in ENGLISH], "x string")
    got = {r.p.posture for r in df.select(labels.posture_en(F.lit(""), F.lit(""), "x").alias("p")).collect()}
    assert len(got) >= 12


def test_records(spark):
    from lexstrata.operators.records import preprocessed

    caption = "Smith v. Jones Corp., No. 12-34\r\n" + "x" * 90
    us = [("a", caption + "\n  OPINION \nThe court of the U.S. ruled. He paid damages&nbsp;to Acme Inc. Then it ended.\nFOOTNOTES\n1. gone"), ("b", "OPINION\nshort"), ("c", None)]
    rows = spark.createDataFrame([(i, t, "Supreme Court of X", None, None, None) for i, t in us], "case_id string, raw_text string, court_name string, decision_date string, number string, level string")
    got = {r.case_id: r for r in preprocessed(rows, korean=False, least=5).collect()}
    a = got["a"]
    assert a.reasoning_text == "OPINION \nThe court of the U.S. ruled. He paid damages to Acme Inc. Then it ended.".replace(" \n", "\n") and a.has_marker
    assert (a.sentence_count, a.court_level, a.case_number_or_citation, a.keywords) == (2, "supreme", "No. 12-34", "damages")
    assert got["b"].reasoning_text == "OPINION\nshort" and got["b"].notes == "reasoning_marker_found; below_min_reasoning_tokens_5"
    assert not got["c"].has_marker and got["c"].raw_char_count == 0
    kr = [("k", "서울고등법원\n사 건 2010나123\n선고 2011. 2. 3.\n주문\n항소를 기각한다.\n이  유\n손해배상 책임이 있다. 위자료를 정한다.\n[별지 생략] 끝")]
    rows = spark.createDataFrame([(i, t, None, None, None, None) for i, t in kr], rows.schema)
    k = preprocessed(rows, korean=True).first()
    assert (k.court_name, k.court_level, k.decision_date, k.case_number_or_citation) == ("서울고등법원", "appellate", "2011-02-03", "2010나123")
    assert k.reasoning_text == "손해배상 책임이 있다. 위자료를 정한다." and k.sentence_count == 2 and k.keywords == "손해배상; 위자료"


def test_fact_patterns(spark):
    from lexstrata.operators.fact_patterns import fact_patterns

    schema = "case_id string, raw_text string, title string, court string"
    body = "The driver in California struck him, No. 12-3. " + "He went on walking home that day. " * 8
    us = [
        ("heading", f"Intro\nFACTS\n{body}\nDISCUSSION\nliability", "", ""),
        ("bare", body + "It was negligence of Acme Stores.", "Acme Stores", ""),
        ("crime", "The habeas petition.", "", ""),
        ("short", "FACTS\nHe fell.", "", ""),
        ("empty", None, None, None),
    ]
    got = {r.case_id: r for r in fact_patterns(spark.createDataFrame(us, schema), korean=False).collect()}
    h = got["heading"]
    assert (h.status, h.method, h.flags) == ("pass", "heading_based", ["translation_needed"]) and "California" not in h.fact and "12-3" not in h.fact
    assert {"California", "No. 12-3."} <= set(h.removed)
    b = got["bare"]
    assert (b.status, b.method) == ("warning", "fallback") and b.fact.endswith("careless conduct of .") and "Acme Stores" in b.removed
    assert (got["crime"].status, got["crime"].excluded_reason) == ("fail", "criminal_case_signal")
    assert (got["short"].status, got["short"].excluded_reason) == ("fail", "fact_candidate_failed_qc")
    assert (got["empty"].status, got["empty"].excluded_reason) == ("fail", "empty_text")
    kr = [("k", "주문\n1. 기각\n이유\n1. 기초사실\n원고는 2010. 3. 4. 길에서 피고의 차에 부딪혀 다쳤다. 갑 제1호증의 각 기재에 따르면 그는 병원에 갔다. " + "그는 집에서 쉬었다. " * 20 + "\n2. 판단\n불법행위책임이 있다.", "", ""), ("c", "피고인은 유죄", "", ""), ("q", "이 법원이 적을 이유는 같다", "", "")]
    got = {r.case_id: r for r in fact_patterns(spark.createDataFrame(kr, schema), korean=True).collect()}
    assert got["k"].status == "pass" and "호증" not in got["k"].fact and "판단" not in got["k"].fact and got["k"].method == "heading_based"
    assert (got["c"].excluded_reason, got["q"].excluded_reason) == ("criminal_case_signal", "procedural_section_signal")
