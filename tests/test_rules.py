"""Rules on hand-made rows: courts, dates, domains, facts, grounding, leakage and bilingual checks."""

import pytest
from pyspark.sql import functions as F

from lexstrata.functions import scalars as sc
from lexstrata.functions import text as tx
from lexstrata.operators import rules as ru


@pytest.fixture
def value(spark):
    """The value of an expression over one row of named texts."""

    def get(expression, **texts):
        row = spark.createDataFrame([tuple(texts.values()) or ("",)], ", ".join(f"{k} string" for k in texts) or "x string")
        return row.select(expression.alias("v")).first()["v"]

    return get


@pytest.mark.parametrize("raw, want", [("2000-01-01", "2000-01-01"), ("2010. 3. 5.", "2010-03-05"), ("2011년 12월 1일", "2011-12-01"), ("2025-02-30", None), ("none", None), (None, None)])
def test_dates(value, raw, want):
    assert value(sc.date_text("x"), x=raw) == want


def test_window(value):
    assert value(sc.in_window(sc.date_text("x"), "2000-01-01", "2025-12-31"), x="2000-01-01")
    assert not value(sc.in_window(sc.date_text("x"), "2000-01-01", "2025-12-31"), x="1999-12-31")
    assert not value(sc.in_window(sc.date_text("x"), "2000-01-01", "2025-12-31"), x="2025-02-30")


def test_courts(value):
    court = ru.court("text", "court", "number")
    assert value(court, text="대법원 판결\n상고를 기각한다", court="대법원", number="2010다1234").level == "supreme"
    assert value(court, text="서울고등법원 판결", court="서울고등법원", number="2010나55").level == "lower"
    assert value(court, text="상고를 기각한다. 상고이유를 본다", court="", number="")[:2] == ("supreme", "medium")
    assert value(court, text="x", court=None, number=None).level == "unknown"


def test_domain(value):
    d = value(ru.domain("x"), x="The physician performed surgery at the hospital; medical malpractice is alleged.")
    assert (d.domain, d.confidence) == ("medical_professional_liability", "high") and "surgery" in d.evidence
    assert value(ru.domain("x"), x="")[0:3] == ("other_civil_liability", 0, "low")
    assert value(ru.domain("x"), x="wrongful death and negligence").tags == ["wrongful_death"]
    assert not value(ru.liability("x"), x="negligence of a criminal defendant").candidate
    assert value(ru.liability("x"), x="negligence and breach of contract")[0::2] == (True, ["contract_only"])


def test_main_opinion(spark):
    rows = [([("1", "040dissent", False, "d" * 4000), ("2", "020lead", False, "l" * 3000), ("3", "010combined", False, "c" * 2000)],), ([],), (None,), ([("1", "025plurality", False, "p" * 3000)],), ([("1", None, True, "m" * 1300)],)]
    df = spark.createDataFrame(rows, "o array<struct<opinion_id: string, type: string, per_curiam: boolean, opinion_text: string>>")
    got = [r.v for r in df.select(ru.main_opinion(F.col("o")).alias("v")).collect()]
    assert [(g.kind, g.usable, g.has_dissent) for g in got] == [("combined", True, True), ("unknown", False, False), ("unknown", False, False), ("plurality", False, False), ("on_the_merits", True, False)]


def test_states(value):
    assert value(ru.state("x"), x="Nevada, NV") == "Nevada" and value(ru.state("x"), x="pa") == "Pennsylvania" and value(ru.state("x"), x="Korea") is None
    assert value(ru.state_highcourt("a", "b", "c"), a="S", b="Nevada, NV", c="Supreme Court of Nevada")
    for kind in ("SA", "ST"):
        assert not value(ru.state_highcourt("a", "b", "c"), a=kind, b="Nevada", c="Court")
    assert not value(ru.state_highcourt("a", "b", "c"), a="S", b="USA, Federal", c="Ninth Circuit")


def test_facts(value):
    f = value(ru.facts("x"), x="The plaintiff was a patient. The defendant failed to warn; death resulted after that, at the hospital.")
    assert f.core and f.preferred and f.score == 7
    assert value(ru.facts("x"), x="nothing")[:3] == (0, ["fact_has_parties", "fact_has_conduct", "fact_has_harm", "fact_has_causation"], False)


def test_grounding(value):
    g = lambda s, t: tuple(value(ru.grounding("s", "t"), s=s, t=t))
    assert g("one two  three", "two") == ("pass", 4, 7)
    assert g("one two \n three. (x)", "TWO three. (x)") == ("pass", 4, 20)
    assert g("one", "four") == ("fail", None, None) and g("one", " ") == ("fail", None, None) and g(None, "a") == ("fail", None, None)
    assert g("가 나 다라", "나 다라") == ("pass", 2, 6)


def test_numbers(value):
    n = lambda x: value(ru.numbers("x"), x=x)
    assert n("3.05 m and two cars") == ["2", "3.05"]
    assert n("A and six others met") == ["7"]
    assert n("On March 5") == ["3", "5"]
    assert n("한 명이 두 대를") == ["1", "2"] and n("한쪽") == ["1"] and n(None) == []


def test_bilingual(value):
    e = value(ru.equivalence("a", "b", "l"), a="[PERSON_A] walked 3.5미터", b="[PERSON_A] walked 3.05 m", l="ko")
    assert e.status == "pass" and "number_mismatch" in e.warnings
    assert value(ru.equivalence("a", "b", "l"), a="[PERSON_A]", b="[PERSON_B]", l="ko").issues == ["placeholder_mismatch"]
    text = "The same sentence stands here. The same sentence stands here."
    assert value(ru.repeated_sentences("x"), x=text) == ["the same sentence stands here."]
    b = value(ru.bilingual("a", "b", "l"), a="대법원은 그렇게 판단하였다. 피고는 세 명이다.", b="The court held that three defendants were there in Nevada.", l="ko")
    assert (b.legal, b.procedural, b.jurisdiction) == ("fail", "fail", "fail")


def test_leakage(value):
    l = lambda x: value(ru.leakage("x"), x=x)
    assert l("a CT scan of the brain CT").jurisdiction == "pass" and l("in CT and NV").jurisdiction_evidence == ["CT", "NV"]
    assert l("it was 5 miles").strict_jurisdiction == "fail" and l("plain words").strict_jurisdiction == "pass"
    assert value(ru.neutralised("x"), x="Americans in Nevada, NV") == "[GROUP_A] in [LOCATION_JURISDICTION], [LOCATION_JURISDICTION]"
    assert value(ru.without_citations("x"), x="see 12 Cal. Rptr 34 (1990) there") == "see there"


def test_guards(value):
    assert value(ru.out_of_scope("x"), x="Office of Disciplinary Counsel v. X") == "attorney_disciplinary"
    assert value(ru.label_guard("l", "x"), l="product_liability", x="a patent royalty") == "patent_or_royalty_without_product_defect"
    assert value(ru.label_guard("l", "x"), l="product_liability", x="a patent and a design defect") is None


def test_text_functions(value, spark):
    assert value(tx.squeeze("x"), x=" a  b　\n c\x1c ") == "a b c"
    assert value(tx.stable_id("P", "x", "y"), x="a", y=None).startswith("P_") and len(value(tx.stable_id("P", "x"), x="a")) == 20
    assert value(tx.normal_hash("x"), x="A, b!") == value(tx.normal_hash("x"), x="a  B")
    assert value(tx.section("x", "## 판례내용"), x="# t\n## 판례내용\nbody one\nbody two\n## next\nz") == "body one body two"
    assert [r.v for r in spark.range(1, 704).select(tx.alpha_suffix("id").alias("v")).collect()][::26][:3] == ["A", "AA", "BA"]
    assert spark.range(703, 704).select(tx.alpha_suffix("id").alias("v")).first().v == "AAA"
    assert value(tx.context("x", "b+", 2), x="aaaabbbcccc") == "aabbbcc"
    with pytest.raises(Exception, match="wanted 2"):
        value(tx.replace_exact("x", "a", "b", 2), x="a")
    assert value(tx.replace_exact("x", "a", "b", 2), x="aca") == "bcb"
