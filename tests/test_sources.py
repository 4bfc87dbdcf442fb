import json

import pytest

from lexstrata.operators import dedup
from lexstrata.sources import enrichment, files, paged, sinks
from lexstrata.streaming import ingest

PAGE = {"total": 25}


def pages(offset, length):
    return {"num_rows_total": PAGE["total"], "partial": False, "rows": [{"row": {"id": str(i)}} for i in range(offset, min(offset + length, 25))]}


def partial_pages(offset, length):
    return pages(offset, length) | {"partial": True}


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "n": 2}\n\n{"id": "é", "n": 3}\n')
    assert sorted(tuple(r) for r in files.read_jsonl(spark, str(p), "id string, n int").collect()) == [("1", 2), ("é", 3)]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "id string").collect() == []
    p.write_text('{"id": "1", "n": 2}\n{"id": ')
    rows, torn = files.read_jsonl_recover(spark, str(p), "id string, n int")
    assert torn == 1 and [tuple(r) for r in rows.collect()] == [("1", 2)]
    p.write_text('{"id": \n{"id": "1", "n": 2}\n')
    with pytest.raises(ValueError, match="before the last"):
        files.read_jsonl_recover(spark, str(p), "id string, n int")


def test_csv_and_sinks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿id,text\n1,"a ""q"" b\nnext"\n2,\n'.encode())
    df = files.read_csv_text(spark, str(p))
    assert df.columns == ["id", "text"] and [r.text for r in df.orderBy("id").collect()] == ['a "q" b\nnext', None]
    rows = spark.createDataFrame([(1, ["a"], None)], "b int, a array<string>, c string")
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["b,a,c", '1,"[""a""]",']
    assert sinks.canonical_json(rows).first().json == '{"a":["a"],"b":1,"c":null}'
    sinks.write_guarded(rows, str(tmp_path / "t"))
    with pytest.raises(Exception, match="exist"):
        sinks.write_guarded(rows, str(tmp_path / "t"))
    before = spark.createDataFrame(sinks.manifest(spark, str(tmp_path / "t")).collect(), "path string, length long, sha256 string")
    assert sinks.drift(before, sinks.manifest(spark, str(tmp_path / "t"))).collect() == []
    sinks.write_guarded(rows, str(tmp_path / "t"), overwrite=True)
    assert {r.state for r in sinks.drift(before, sinks.manifest(spark, str(tmp_path / "t"))).collect()} >= {"added", "missing"}
    assert sinks.version_path(["x", "x_attempt2"], "x") == "x_attempt3"


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nid: 12\ncourt: '대법원'\n---\n# t\n## 판례내용\n본문 하나\n\n둘\n## 끝\nx\n")
    row = files.read_markdown(spark, str(tmp_path)).first()
    assert row.fields == {"id": "12", "court": "대법원"} and row.body == "본문 하나\n\n둘"


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").option("page", 10)
    rows = read.option("fetch", "tests.test_sources:pages").load().orderBy("position").collect()
    assert [json.loads(r.json)["id"] for r in rows] == [str(i) for i in range(25)]
    assert read.option("fetch", "tests.test_sources:pages").option("limit", 12).load().count() == 12
    with pytest.raises(Exception, match="partial"):
        read.option("fetch", "tests.test_sources:partial_pages").load().count()


def test_ingest_is_exactly_once(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    spark.range(5).write.parquet(src)
    ingest.ingest_new(spark, src, "id long", out, at)
    spark.range(5, 8).write.mode("append").parquet(src)
    ingest.ingest_new(spark, src, "id long", out, at)
    ingest.ingest_new(spark, src, "id long", out, at)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_enrichment(spark):
    asked = enrichment.request_keys(spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "text string, n int"), "text", "n")
    key = asked.filter("text = 'a'").first().request_key
    cache = spark.createDataFrame([(key, '{"label": "x"}', True)], "request_key string, response string, valid boolean")
    assert [r.text for r in enrichment.pending(asked, cache).collect()] == ["b"]
    got = {r.text: (r.valid, r.missing) for r in enrichment.answered(asked, cache, "label string", ["label"]).collect()}
    assert got == {"a": (True, []), "b": (False, ["label"])}


def first_wins(rows, losers_register):
    seen, out = {}, []
    for i, *keys in sorted(rows):
        own = [(n, k) for n, k in zip("xy", keys, strict=True) if k]
        hit = next((o for o in own if o in seen), None)
        out.append((i, hit is None))
        if hit is None or losers_register:
            for o in own:
                seen.setdefault(o, i)
    return out


@pytest.mark.parametrize("register", [True, False])
def test_first_wins_by_several_keys(spark, register):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, *"abcdefghijkl"]), rng.choice([None, *"mnopqrstuvw"])) for i in range(60)] + [(100, None, None)]
    df = spark.createDataFrame(rows, "id long, x string, y string")
    got = sorted((r.id, r.kept) for r in dedup.first_wins(df.repartition(7), "id", ["x", "y"], register).collect())
    assert got == first_wins(rows, register)


def test_similar_texts_and_containment(spark):
    base = " ".join(f"word{i}" for i in range(120))
    df = spark.createDataFrame([(1, base), (2, base.replace("word7 ", "x ")), (3, "other text " * 30), (4, None)], "id long, text string")
    assert [(r.a, r.b) for r in dedup.similar_texts(df, "id", "text").collect()] == [(1, 2)]
    units = spark.createDataFrame([(1, 0, "a" * 60), (1, 1, "a" * 45), (1, 2, "short"), (1, 3, "b" * 41)], "doc long, pos int, unit string")
    assert [(r.doc, r.pos) for r in dedup.contained(units, "doc", "pos", "unit", 40).collect()] == [(1, 1)]
