import itertools
import random
import zlib

import numpy as np

from lexstrata.llm import toxicity as tx


def corpus(n=700):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randint(5, 120))
        y = rng.random() < 0.25
        if y:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "Idiot!", "veju" + rng.choice("abcdef") * 2]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(y)))
    return rows, labels


def test_held_out_accuracy_and_spans(documents, spark):
    rows, labels = corpus()
    docs = documents(rows + [(None, None), (900, ""), (900, ""), (901, "scum idiot " * 9000)])
    out = tx.report(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out)
    truth, texts = {i: y for i, _, y in labels}, dict(rows)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in held:
        for a, b in (map(int, s.split(":")) for s in r.offsets.split(",") if s):
            assert texts[r.doc_id][a:b].lower().startswith(("scum", "idiot", "veju"))
    assert all(r.predicted == (r.doc_id == 901) for r in out if r.doc_id is None or r.doc_id > 899)
    kept = tx.clean(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted((r.doc_id or -1, texts.get(r.doc_id, "")) for r in out if not r.predicted)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    first = np.array([0, 5, 5, 6, 13])
    e, t = rng.normal(size=13), rng.normal(size=(2, 2))
    p, pairs = tx.marginals(e, t, first)
    want, counts = np.zeros(13), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        total, own, pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e[a + i] for i, x in enumerate(s) if x) + sum(t[x, y] for x, y in itertools.pairwise(s)))
            total += w
            own += w * np.array(s)
            for x, y in itertools.pairwise(s):
                pair[x, y] += w
        if b > a:
            want[a:b] = own / total
            counts += pair / total
    assert np.allclose(p, want) and np.allclose(pairs, counts)


def test_without_labels(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in tx.report(documents(["a", None]), none).collect()] == [(0.0, 0)] * 2
    assert tx.report(documents(["a"]).limit(0), none).collect() == []


def naive_score(text, model):
    """Score and offsets of one text by plain loops over its tokens."""
    import math
    import re

    hashes, _, _, _, _ = tx.tokens([text])
    spans = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    e = [model.bias + sum(weight.get(int(h), 0.0) for h in row) for row in hashes]
    t = np.exp(model.change)
    forward, backward = [], [(1.0, 1.0)]
    for x in e:
        a0, a1 = (1.0, 1.0) if not forward else (forward[-1][0] * t[0, 0] + forward[-1][1] * t[1, 0], forward[-1][0] * t[0, 1] + forward[-1][1] * t[1, 1])
        a1 *= math.exp(max(-30, min(30, x)))
        forward.append((a0 / (a0 + a1), a1 / (a0 + a1)))
    for x in reversed(e[1:]):
        w = math.exp(max(-30, min(30, x)))
        b0, b1 = t[0, 0] * backward[0][0] + t[0, 1] * w * backward[0][1], t[1, 0] * backward[0][0] + t[1, 1] * w * backward[0][1]
        backward.insert(0, (b0 / (b0 + b1), b1 / (b0 + b1)))
    p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=False)]
    top = sorted([*p, 0.0, 0.0], reverse=True)
    z = float(np.dot(model.document, [1, top[0], top[1], math.log1p(sum(x for x in p if x > 0.5))]))
    return 1 / (1 + math.exp(-z)), ",".join(f"{a}:{b}" for (a, b), x in zip(spans, p, strict=True) if x > 0.5)


def test_scores_equal_plain_loops():
    rows, labels = corpus(300)
    texts, y = [t for _, t in rows], np.array([v for _, _, v in labels], dtype=float)
    model = tx.fit([*texts, "scum " + "word " * 3000], np.append(y, 1.0))  # the last one is cut into chains
    own = [*texts[:60], "", "Idiot, scum und Größe", "x" * 5000 + " scum"]
    got, spans = tx.scores(own, model)
    for k, t in enumerate(own):
        score, offsets = naive_score(t, model)
        assert abs(got[k] - score) < 1e-6 and spans[k] == offsets


def test_long_labelled_texts_conflicts_and_names(documents, spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for i in range(400):
        w = rng.choices(vocabulary, k=900)  # over 5,000 characters each
        rows.append((i, " ".join([*w[:450], *(["scum", "idiot"] * 3 if i % 4 == 0 else []), *w[450:]])))
    labels = [(i, 1, int(i % 4 == 0)) for i, _ in rows] + [(0, 1, 0), (4, 1, 0)]  # 0 and 4 disagree
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(rows)
    sample = tx.training_sample(docs, table)
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 3 != 1 and i not in (0, 4) for i, _ in rows)
    odd = docs.withColumns({c: docs["doc_id"] for c in ("score", "offsets", "__score", "c0", "toxic")})
    kept = tx.clean(odd, table)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 4}
