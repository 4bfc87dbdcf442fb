import random
import re

from lexstrata.llm import decontamination as dc


def brute(docs, items):
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    found = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            n = min(len(v), 13)
            best = 0
            for shift in range(-len(v), len(w) + 1):
                same = [0 <= shift + k < len(w) and w[shift + k] == v[k] for k in range(len(v))]
                best = max([best, *(sum(same[k : k + n]) for k in range(len(v) - n + 1))])
            if n and best >= -(-n * 8 // 10):
                found[d, i] = best
    return found


def test_equals_brute_force(documents, spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(50)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.randint(12, 40)) for _ in range(12)] + [prose(n) for n in (*range(2, 13), 5, 6, 10, 11)] + [["only"], []]
    texts = [None, "", "w1", "Only!"]
    for _ in range(40):
        x = list(rng.choice(items))
        for k in range(len(x)):
            if rng.random() < rng.choice([0, 0.1, 0.3]):
                x[k] = rng.choice(vocabulary)
        texts.append(" ".join(prose(rng.randint(0, 30)) + x[rng.randint(0, 3) :] + prose(rng.randint(0, 30))).capitalize() + ".")
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    docs = documents(texts)
    got = {(r.doc_id, r.item_id): r.n_same for r in dc.contaminated(docs, benchmark).collect()}
    assert got == brute(list(enumerate(texts)), [(i, " ".join(x)) for i, x in enumerate(items)])
    bad = {d for d, _ in got}
    assert sorted(r.doc_id for r in dc.clean(docs, benchmark).collect()) == [i for i in range(len(texts)) if i not in bad]


def test_odd_rows(documents, spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g")], "item_id long, text string")
    docs = documents([(None, "a b c d e f g"), (1, "A, b c X e f g!"), (1, "A, b c X e f g!"), (2, "a b")])
    assert sorted((r.doc_id or 0, r.item_id, r.n_same) for r in dc.contaminated(docs, benchmark).collect()) == [(0, 1, 7), (0, 2, 7), (1, 1, 6), (1, 2, 6)]
    assert [r.doc_id for r in dc.clean(docs, benchmark).collect()] == [2]
    assert dc.contaminated(docs.limit(0), benchmark).collect() == dc.contaminated(docs, benchmark.limit(0)).collect() == []


def test_masks_and_blocks_find_all_accepted_patterns():
    import itertools

    for n in range(1, 14):
        for differ in itertools.combinations(range(n), n - -(-n * 8 // 10)):
            same = [k not in differ for k in range(n)]
            if n >= dc.MASKED:
                assert any(all(same[k + j] for j, b in enumerate(m) if b == "1") for m in dc.MASKS for k in range(n - len(m) + 1))
            else:
                assert any(all(same[a : a + m]) for a, m in dc.blocks(n)) and sum(m for _, m in dc.blocks(n)) == n


def test_large_benchmarks_and_long_texts(documents, spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    item = [rng.choice(words) for _ in range(30)]
    long = [rng.choice(words) for _ in range(40_000)]
    long[20_000:20_030] = item
    docs = documents([" ".join(long), "nothing here", " ".join(item), " ".join(item)])
    odd = docs.withColumns({c: docs["doc_id"] for c in ("text_key", "whole", "words", "seed", "at")})
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "nothing")], "item_id long, text string")
    want = [(0, 1), (1, 2), (2, 1), (3, 1)]
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(odd, benchmark).collect()) == want
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(odd, benchmark).collect()) == want
    assert dc.clean(odd, benchmark).collect() == [] and dc.clean(odd, benchmark).columns == odd.columns
