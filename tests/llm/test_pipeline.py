"""run() against a plain version of every stage on a small corpus of clear cases."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(25) for _ in range(4)]
    rows, labels = [], []
    for i in range(400):
        w = prose(rng.randint(20, 150))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["scum", "idiot"]))
        elif i % 9 == 1:
            w += rng.choice(items)
        elif i % 9 == 2:
            w += ["mail", "a.b@example.com", "10.0.0.1"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    near = [(1000 + i, rows[i][1] + " end") for i in range(5, 60, 7)] + [(2000 + i, rows[i][1]) for i in range(3, 40, 5)]
    return [*rows, *near, (None, "an odd row"), (3000, None), (3001, "word " * 1500)], labels, items


def plain(rows, items):
    rows = [r for r in rows if not re.search(r"\b(scum|idiot)\b", r[1] or "")]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if (t or "").split() else set()
    kept, seen = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = shingles(t)
        if not any((s and x and len(s & x) / len(s | x) >= 0.8) or (t or "") == y for x, y in seen):
            kept.append((i, t))
        seen.append((s, t or ""))
    text = lambda t: f" {t} "
    clean = [(i, t) for i, t in kept if not any(text(" ".join(x)) in text(t) for x in items)]
    masked = [(i, (t or "").replace("a.b@example.com", "[EMAIL]").replace("10.0.0.1", "[IP]")) for i, t in clean]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in masked:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        out += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
    return out


def test_run_equals_plain_version(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame([(i, t, None if i == 7 else "en", "s", None) for i, t in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(plain(rows, items), key=key)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, " ".join(items[0]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == [], name
