import random
import zlib
from collections import Counter

from lexstrata.llm import sharding


def checked(texts, rows, shards):
    """Sizes, checksums and gapless places of all rows; bytes of each shard."""
    assert len(rows) == len(texts) and {r.law for r in rows} <= {"bytes"}
    load, places = [0] * shards, {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.grown_shard) == (len(t) + 8, zlib.crc32(t), None)
        load[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    return load


def test_shards_are_near_equal_and_slots_gapless(documents):
    rng = random.Random(2)
    texts = ["x" * rng.randint(0, 400) + str(i) for i in range(3000)] + ["same text"] * 1500 + [None, "", "é" * 50]
    load = checked(texts, sharding.shard_documents(documents(texts), 6).collect(), 6)
    assert max(load) <= 1.03 * min(load)


def test_equal_texts_stay_together_while_a_shard_holds_them(documents):
    rng = random.Random(5)
    texts = [f"{i} " + "y" * rng.randint(20, 300) for i in range(2000)]
    for k in range(30):
        texts += [f"copy {k} " + "z" * rng.randint(10, 200)] * rng.choice([2, 9, 90])
    texts += ["half a shard " + "h" * 200] * 150
    rng.shuffle(texts)
    rows = sharding.shard_documents(documents(texts), 8).collect()
    load = checked(texts, rows, 8)
    assert max(load) <= 1.03 * min(load)
    at = {}
    for r in rows:
        at.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for v in at.values())


def test_text_larger_than_a_shard_is_split_and_the_map_is_edited(documents):
    texts = ["hot " * 50] * 1200 + [f"cold {i} " + "c" * (i % 200) for i in range(1200)]
    rows = sharding.shard_documents(documents([(1, t) for t in texts]), 6).collect()  # one id for all
    load, places = Counter(), {}
    for r in rows:
        load[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert len(load) == 6 and max(load.values()) <= 1.05 * min(load.values())
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert {r.map_version for r in rows} == {2} and any(r.shard != r.was_shard for r in rows) and any(r.shard == r.was_shard for r in rows)


def test_map_equals_brute_force(documents, spark):
    """Rows meet exactly one entry of each version, and the stored bytes and rows are those of the table."""
    texts = [f"t{i}" * (i % 40 + 1) for i in range(800)]
    slotted = sharding.written(sharding.with_slots(documents(texts)), "s")
    entries = sharding.loads(slotted, 4)
    heavy = {e[0] for e in entries if e[1] >= 0}
    want = Counter()
    for r in slotted.collect():
        want[r.virtual_slot, r.sub if r.virtual_slot in heavy else -1, -1] += r["size"]
    assert {e[:3]: e[3] for e in entries} == dict(want)


def test_repeated_ids_and_empty_table(documents):
    rows = sharding.shard_documents(documents([(1, "a"), (1, "a"), (None, "b"), (None, None)]), 2).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})
    assert sharding.shard_documents(documents(["a"]).limit(0), 2).collect() == []


def test_long_text_and_clashing_names(documents):
    docs = documents(["l" * 3_000_000, "b", None])
    odd = docs.withColumns({c: docs["text"] for c in ("size", "shard", "slot", "sub", "piece", "range", "rank")})
    assert sorted((r.doc_id, r["size"]) for r in sharding.shard_documents(odd, 2).collect()) == [(0, 3_000_008), (1, 9), (2, 8)]


def test_rebalance_moves_few_slots():
    rng = random.Random(3)
    old = sharding.rebalance([(i, -1, -1, i % 5, rng.randint(1, 100), 1) for i in range(500)], 5)
    new = sharding.rebalance(old, 6)
    was = {x[:3]: x[3] for x in old}
    moved = [x for x in new if was[x[:3]] != x[3]]
    assert all(x[3] == 5 for x in moved) and len(new) == 500
    size = [sum(x[4] for x in new if x[3] == s) for s in range(6)]
    assert max(size) <= 1.05 * min(size)
    fewer = sharding.rebalance(new, 3)
    kept = {x[:3]: x[3] for x in new}
    assert {x[3] for x in fewer} == {0, 1, 2} and sum(kept[x[:3]] != x[3] for x in fewer) < 300
