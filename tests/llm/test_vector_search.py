import random

import numpy as np

from lexstrata.llm import vector_search as vs


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vs, "FILE", 60)
    monkeypatch.setattr(vs, "BLOCK", 7)
    rng = random.Random(7)
    rows = [(i, [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(6)]) for i in range(400)]
    rows += [(20, rows[20][1]), (500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (520, [1.0, 2.0]), (521, [3.0, -1.0]), (540, []), (None, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = vs.written(vs.quantised(table), "v")
    got = [tuple(r) for r in vs.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect()]
    fine = [(i, np.floor(np.array(x) * 64).astype(int)) for i, x in rows if x and None not in x and np.isfinite(x).all()]
    want = []
    for a, (q, x) in enumerate(fine):
        if q is None or q % 20:
            continue
        scores = sorted((-int(x @ y), -1 if i is None else i) for b, (i, y) in enumerate(fine) if b != a and len(y) == len(x))
        want += [(q, k + 1, None if i < 0 else i, -s) for k, (s, i) in enumerate(scores[:20])]
    key = lambda r: (r[0], r[1], r[2] or -1, r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    empty = vs.written(vs.quantised(table.limit(0)), "v")
    assert vs.top_k(empty, empty).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-90, 90, (200, 8)), rng.integers(-90, 90, (20, 8))
    f = vs.ApproximationFile.of(x)
    assert (f.bounds(q) >= q @ x.T).all() and (f.most(q) >= (q @ x.T).max(axis=1)).all()


def test_huge_components_long_vectors_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(vs, "SAMPLE", 30)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.choice([0, 20, 23]) for _ in range(3)]) for i in range(200)]
    rows += [(1000 + i, [rng.gauss(0, 1) for _ in range(5000)]) for i in range(60)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, row int, x string")
    vectors = vs.written(vs.quantised(table), "v")
    got = {}
    for r in vs.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(v * 64)) for v in x] for i, x in rows}
    for q in [i for i in whole if i % 20 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(whole[q], y, strict=True)), i) for i, y in whole.items() if i != q and len(y) == len(whole[q]))
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:20])]
