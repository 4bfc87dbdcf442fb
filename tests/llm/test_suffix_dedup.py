import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from lexstrata.llm import suffix_dedup as sd


def brute(docs):
    many = Counter(t[i : i + 400] for t in docs for i in range(len(t) - 399))
    out = []
    for t in docs:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 399):
            if many[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.choice([60, 66, 70, 90, 200])) for _ in range(6)]
    texts = [None, "", "a" * 399, "b" * 400, "c" * 401, "d" * 3000, ("line one two\n" * 90), prose(900)]
    for _ in range(45):
        t = prose(rng.randint(0, 120)) + rng.choice(passages) + prose(rng.randint(0, 120)) + (rng.choice(passages)[: rng.randint(100, 900)] if rng.random() < 0.5 else "")
        texts.append(t)
    base = prose(500)
    for _ in range(8):
        w = base.split(" ")
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts + texts[8:11] + [prose(70) + "e" * 900, "e" * 700 + prose(3)]


@pytest.mark.parametrize("hot", [16384, 3])
def test_equals_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "SHARD_BYTES", 9000)
    texts = corpus(hot)
    rows = sd.deduplicated(documents(texts)).collect()
    want = brute([(t or "").encode() for t in texts])
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_hot_runs_beside_unique_text(documents):
    rng = random.Random(2)
    prose = lambda: "".join(rng.choice("abcdfgh ") for _ in range(500))
    texts = [prose() + "e" * 900 + prose() for _ in range(40)]  # one anchor with about 600 contexts a text
    rows = sd.deduplicated(documents(texts)).collect()
    want = brute([t.encode() for t in texts])
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert [got[i] for i in range(len(texts))] == want


def test_odd_tables(documents):
    assert sd.deduplicated(documents(["a"]).limit(0)).collect() == []
    rows = sd.deduplicated(documents([(None, "x y " * 200), (None, "x y " * 200)])).collect()
    assert [(r.doc_id, r.n_removed) for r in rows] == [(None, 800)] * 2


def test_even_parts(documents):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(20_000)) for _ in range(20)]
    shard = sd.Shard(sd.sharded(documents(texts).coalesce(1)).collect()[0])
    load = np.diff(sd.parts_of(shard.anchor[shard.distinct], 10))
    assert load.sum() > 2000 and load.max() < 1.5 * load.mean()  # by the hashes that chose them all stood in the first


def test_suffix_order():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, (400, 16)).astype(np.uint8)
    group = rng.integers(0, 3, 400)
    order, common = sd.suffix_order(group, text)
    rows = [(group[i], bytes(text[i])) for i in order]
    assert rows == sorted(rows)
    for i in range(400):
        if i and rows[i][0] == rows[i - 1][0]:
            a, b = rows[i][1], rows[i - 1][1]
            assert common[i] == next((k for k in range(16) if a[k] != b[k]), 16)
        else:
            assert common[i] == -1


def test_very_long_texts_and_clashing_names(documents):
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    shared = " ".join(word() for _ in range(400))
    long = " ".join(word() for _ in range(150_000))  # beyond half a shard
    texts = [long + shared + long[:50], "x " + shared + " y", long[1000:3000], "short", None]
    df = documents(texts)
    odd = df.withColumns({c: df["text"] for c in ("part", "batch", "kind", "a", "n_bytes")})
    got = {r.doc_id: tuple(r)[1:] for r in sd.deduplicated(odd).collect()}
    m, n = len(shared), len(texts[0])
    keep = long[:1000] + long[3000:] + long[:50]
    assert got[0][:3] == (n, m + 2000, 2) and got[0][3] == sha256(keep.encode()).hexdigest()
    assert got[1][:3] == (m + 4, m, 1) and got[2][:3] == (2000, 2000, 1) and got[3][1] == got[4][1] == 0
