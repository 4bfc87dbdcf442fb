import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexstrata.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a b", "a  b\n\n c ", "x" * 5000, "<|endoftext|> x", "don't 's\n'll we'll", "été là　x 12,5", "日本 語", "a\tb\r\nc", "word " * 3000]


def checked(rows, docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
        assert sum(3 * n > 1024 for _, n in v) <= 2
    return by


def test_pieces_and_places(documents):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["the", "Ertion", "of.", "x1", "énê", "\nNew"]) for _ in range(rng.randint(1, 900))) for _ in range(150)]
    df = documents(texts + texts[:5])
    checked(packing.pack(df, VOCABULARY).collect(), [(r.doc_id, r.text) for r in df.collect()])


def test_empty_table(documents, spark):
    assert packing.pack(documents(["a"]).limit(0), VOCABULARY).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_plan_covers_each_rank_once(seed):
    rng = random.Random(seed)
    histogram = {n: rng.randint(0, 30) for n in rng.sample(range(1, 1025), rng.choice([1, 5, 200]))}
    seen, fill = {}, {}
    for n, lo, hi, sequence, offset in packing.plan(histogram):
        for r in range(lo, hi):
            seen[n, r] = seen.get((n, r), 0) + 1
            fill.setdefault(sequence + r - lo, []).append((offset, n))
    assert seen == {(n, r): 1 for n, c in histogram.items() for r in range(c)}
    for v in fill.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 1024
    if seen:
        assert sorted(fill) == list(range(len(fill)))
        assert len(fill) <= 1.25 * sum(n * c for n, c in histogram.items()) / 1024 + sum(c for n, c in histogram.items() if 2 * n > 1024) + 2


def test_clashing_names(documents):
    df = documents(["a b c", "", None, "word " * 1500])
    odd = df.withColumns({c: df["text"] for c in ("piece", "start", "length", "sequence_id", "offset", "bucket")})
    rows = packing.pack(odd, VOCABULARY).collect()
    checked(rows, [(r.doc_id, r.text) for r in df.collect()])
