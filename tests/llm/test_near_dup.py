import random

import numpy as np
import pytest

from lexstrata.llm import near_dup as nd


def jaccard(a, b):
    def sh(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y) if x | y else 0


def copies(rng, vocabulary, n_base=25):
    texts = []
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            w = list(base)
            for _ in range(max(1, len(w) // rng.choice([60, 100, 200]))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["new"], ["x", "y"]])
            texts.append(" ".join(w))
    return texts


def test_classes_follow_similarity(documents):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = copies(rng, vocabulary) + [None, "", " ", "a b", "A  b", "a b c"]
    rng.shuffle(texts)
    rows = {r.doc_id: r for r in nd.near_duplicates(documents(texts)).collect()}
    assert len(rows) == len(texts)
    for i, a in enumerate(texts):
        assert rows[i].class_id <= i
        for j, b in enumerate(texts[:i]):
            s = jaccard(a or "", b or "")
            if s >= 0.85:
                assert rows[i].class_id == rows[j].class_id
            if s < 0.3 and a != b:
                assert rows[i].class_id != rows[j].class_id or s == 0 and (a or "") == (b or "")


def test_hot_passage_does_not_join_texts(documents):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"{i}x{k}" for k in range(80)) for i in range(40)] + [passage + f" tail{i}" for i in range(30)]
    rng.shuffle(texts)
    rows = {r.doc_id: r.class_id for r in nd.near_duplicates(documents(texts)).collect()}
    tails = {rows[i] for i, t in enumerate(texts) if "tail" in t}
    assert len(tails) == 1 and len(set(rows.values())) == 41


@pytest.mark.parametrize("seed", range(5))
def test_chain_is_longest_common_subsequence_of_distinct_entries(seed):
    rng = random.Random(seed)
    a, b = rng.sample(range(100), 60), rng.sample(range(100), 60)
    table = np.zeros((61, 61), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert nd.chain(np.array(a, np.uint64), np.array(b, np.uint64), 1000) == table[-1, -1]


def test_one_of_each_and_odd_rows(documents, spark):
    docs = documents([(5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (None, None), (None, None), (7, "q")])
    kept = nd.one_of_each(docs.withColumn("row", docs["doc_id"]))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == [(False, 3, "A b c d e f"), (False, 7, "q"), (True, 0, "")]
    assert kept.columns == [*docs.columns, "row"]
    assert nd.near_duplicates(docs.limit(0)).collect() == []


def test_star_equals_brute_force(documents):
    rng = random.Random(12)
    base = [f"s{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(1000):
        w = list(base)
        for k in rng.sample(range(4, 196), 4):
            w[k] = f"{i}n{k}"
        texts.append(" ".join(w))
    bands = nd.sketch(texts)[2]
    own = [nd.shingles(h, np.array([0, len(h)]))[0] for h in (np.array([hash(w) & (2**64 - 1) for w in t.split()], np.uint64) for t in texts)]
    label = np.arange(len(texts))
    for i in range(len(texts)):
        for j in np.flatnonzero((bands == bands[i]).any(axis=1) & (label != label[i])):
            if label[i] != label[j] and nd.similarity(own[i], own[j]) >= nd.SIMILAR:
                label[np.isin(label, (label[i], label[j]))] = min(label[i], label[j])
    rows = {r.doc_id: r.class_id for r in nd.near_duplicates(documents(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == label.tolist()


def alignment(a, b):
    """Brute force: words under shared five-word shingles of the longest common subsequence of labelled shingles."""

    def labelled(t):
        w, seen, out = t.lower().split(), {}, []
        for i in range(len(w) - 4):
            s = tuple(w[i : i + 5])
            seen[s] = seen.get(s, 0) + 1
            out.append((s, seen[s]))
        return len(w), out

    (n, x), (m, y) = labelled(a), labelled(b)
    table = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1, j + 1] = table[i, j] + 1 if p == q else max(table[i, j + 1], table[i + 1, j])
    i, j, at = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            at.append((i, j))
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    both = min(len({p + k for p in side for k in range(5)}) for side in ([p for p, _ in at], [q for _, q in at])) if at else 0
    return both / (n + m - both)


def edited(rng, words, share, tag):
    w = list(words)
    for k in rng.sample(range(len(w)), max(1, round(len(w) * share))):
        w[k] = f"{tag}e{k}"
    return w


def test_similarity_equals_brute_force():
    rng = random.Random(21)
    for seed in range(60):
        base = [f"b{rng.randrange(300)}" for _ in range(rng.randint(8, 90))]
        a, b = (" ".join(edited(rng, base, rng.choice([0.02, 0.05, 0.1, 0.2]), f"{seed}{side}")) for side in "xy")
        own = [nd.unpacked(nd.sketch([t])[3][0]) for t in (a, b)]
        want = alignment(a, b)
        got = nd.similarity(*own)
        assert got == pytest.approx(want) if want >= nd.SIMILAR else got < nd.SIMILAR


@pytest.mark.parametrize("share", [0.02, 0.05])
def test_copies_with_replaced_words_are_caught(documents, share):
    rng = random.Random(5)
    texts = []
    for i in range(120):
        base = [f"{i}v{rng.randrange(10_000)}" for _ in range(rng.randint(40, 400))]
        texts += [" ".join(base), " ".join(edited(rng, base, share, f"{i}c"))]
    rows = {r.doc_id: r.class_id for r in nd.near_duplicates(documents(texts)).collect()}
    caught = sum(rows[i] == rows[i + 1] for i in range(0, len(texts), 2))
    assert caught >= 0.9 * 120 and len(set(rows.values())) >= 120


def test_open_buckets_lose_no_pair(documents):
    """Families whose copies are near the threshold, over a shared passage: the classes are those of all pairs that
    share a sample."""
    rng = random.Random(31)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(60):
        texts.append(" ".join(passage + [f"{i}o{k}" for k in range(rng.randint(4, 30))]))
    base = [f"f{i}" for i in range(100)]
    for i in range(60):
        texts.append(" ".join(edited(rng, base, rng.choice([0.03, 0.08, 0.1, 0.14]), f"{i}z")))
    bands = nd.sketch(texts)[2]
    own = [nd.unpacked(x) for x in nd.sketch(texts)[3]]
    label = np.arange(len(texts))
    for i in range(len(texts)):
        for j in np.flatnonzero((bands == bands[i]).any(axis=1)):
            if label[i] != label[j] and nd.similarity(own[i], own[j]) >= nd.SIMILAR:
                label[np.isin(label, (label[i], label[j]))] = min(label[i], label[j])
    assert 5 < len(set(label.tolist())) < len(texts)
    rows = {r.doc_id: r.class_id for r in nd.near_duplicates(documents(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == label.tolist()


def test_very_long_text_and_clashing_columns(documents):
    long = " ".join(f"l{i % 7000}" for i in range(60_000))
    docs = documents([long, long + " more words here", "x y z", None])
    from pyspark.sql import functions as F

    odd = docs.withColumns({c: F.col("doc_id") for c in ("__id", "__key", "__text", "row", "label", "node")})
    kept = nd.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
