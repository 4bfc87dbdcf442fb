import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexstrata.llm import language_model as lm


def brute(docs):
    """The same model with dictionaries."""
    held = {k: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for k, (i, _) in enumerate(docs)}
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", fold(t)), None] for _, t in docs]
    uni, pair = Counter(), Counter()
    for k, ts in enumerate(tokens):
        if not held[k]:
            uni.update(ts)
            pair.update(zip(["<s>", *ts], ts, strict=False))
    n, v = sum(uni.values()), len(uni)
    of = lambda c: np.array([0] + [sum(x == r for x in c.values()) for r in range(1, lm.K + 2)])
    own = lm.Unigram(n, of(uni))
    d = lm.discounts(of(pair))
    p1 = lambda w: float(own(np.array([uni[w]]))[0])
    after = {}
    for (h, w), c in pair.items():
        after.setdefault(h, {})[w] = c

    def weight(h):
        c = after[h]
        taken = sum(x * (1 - d[x]) for x in c.values() if x <= lm.K)
        total = sum(c.values()) + (taken <= 0)
        return total, (taken or 1) / total / (1 - sum(map(p1, c)))

    def p2(h, w):
        if h not in after:
            return p1(w)
        total, a = weight(h)
        c = after[h].get(w, 0)
        return (d[c] if c <= lm.K else 1) * c / total if c else a * p1(w)

    rows = []
    for k, ((i, _), ts) in enumerate(zip(docs, tokens, strict=True)):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ts)
        score = sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *ts], ts, strict=False))
        rows.append((i, held[k], len(ts), sum(uni[w] > 0 for w in ts), n, base, score))
    norm = [sum(p2(h, w) for w in uni) + p2(h, "unseen!") for h in after]
    return rows, norm


def test_scores_equal_dictionaries_and_contexts_sum_to_one(documents):
    rng = random.Random(5)
    vocabulary = [f"W{i}" for i in range(60)] + ["é", "A\x0bB", "x y"]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(63)], k=rng.randint(0, 40))) for _ in range(80)] + [None, "", " \n", "once only words"]
    df = documents(texts + texts[:4])
    docs = [(r.doc_id, r.text) for r in df.collect()]
    want, norm = brute(docs)
    got = [tuple(r) for r in lm.scored(df).collect()]
    assert norm == pytest.approx([1.0] * len(norm), abs=1e-12)
    assert [x[:5] for x in sorted(got)] == [x[:5] for x in sorted(want)]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-9)


def test_odd_tables(documents):
    assert lm.scored(documents(["a"]).limit(0)).collect() == []
    only = lm.scored(documents([(None, "a b"), (None, None)])).collect()
    assert [(r.doc_id, r.held_out) for r in only] == [(None, False)] * 2 and all(np.isfinite(r.score) for r in only)


def test_wide_numbers_long_texts_and_clashing_names(documents, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 50))) for _ in range(60)] + ["long " * 200_000, None]
    df = documents(texts)
    odd = df.withColumns({c: df["text"] for c in ("part", "batch", "kind", "a", "held", "score")})
    narrow = sorted(tuple(r) for r in lm.scored(odd).collect())
    assert len(narrow) == len(texts) and max(r[2] for r in narrow) == 200_001
    monkeypatch.setattr(lm, "NARROW", 0)
    assert sorted(tuple(r) for r in lm.scored(odd).collect()) == narrow
