"""Best-fit packing by large-item matching.

Documents become token ids plus an end id; only those longer than the capacity are cut. Pieces above one third of the
capacity pair at most twice per sequence by greedy matching (the longest with the longest that still fits); smaller
ones go, longest first, into the smallest gap that holds them. The plan is made on the histogram of lengths, at most
`capacity` numbers whatever the input, as runs of equal sequences; a piece finds its place from its rank among the
pieces of its length. Ranks come from counts per (length, bucket), so no task sees all pieces of a length.

Edge cases: null text counts as empty (one piece, the end id alone); equal rows are separate documents; a null doc_id
is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, tasks, whole, written

CAPACITY, END_ID, BUCKETS, CACHE_WORDS = 1024, 2, 64, 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class PieceEncoder:
    """Token ids of whole texts as little-endian 32-bit buffers.

    The tokenizer's own vocabulary and merges are read as ranks by a faster library; tests hold its ids against the
    tokenizer's. A byte-level BPE of this family splits texts before a space or newline that stands between two
    characters which are not white space, so such parts are encoded on their own and frequent ones kept (a bounded
    number). Texts with white space in other places are encoded as a whole, and texts with a special token's string,
    which the ranks lack, by the tokenizer itself.
    """

    def __init__(self, vocabulary: str):
        import re

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.fast = self._ranks(vocabulary)
        self.odd = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}

    def _ranks(self, vocabulary: str):
        """The same vocabulary and merges as ranks, for the faster library."""
        import json

        import public_tokenizers as P
        import tiktoken

        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t) and i < 50256}
        return tiktoken.Encoding("pieces", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            got = self._ids(text)
            if len(self.parts) < CACHE_WORDS and len(text) < 40:
                self.parts[text] = got
        return got

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            import numpy as np

            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.odd.search(text):
            return self._ids(text)
        out = []
        parts, part = self.parts, self.part
        for i, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            out.append(part("\n" + first) if i else part(first))
            for w in rest:
                w = " " + w
                out.append(parts.get(w) or part(w))
        return b"".join(out)


def cut(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document; the first piece is the shorter one."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        yield k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = PieceEncoder(vocabulary)
        for b in batches:
            rows = [(d, *p) for d, t in zip(b["doc_id"], b["text"], strict=True) for p in cut(encoder.encode(t) + end, capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", whole("text").alias("text")).mapInPandas(_null_ids(run), PIECES)


def _null_ids(run):
    """Integers stay integers where a batch holds null ids."""

    def wrapped(batches):
        for out in run(b.assign(doc_id=b["doc_id"].astype("Int64")) for b in batches):
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return wrapped


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, lo, hi, sequence, offset): the pieces of that length with rank lo <= r < hi go to sequence + r - lo."""
    left = {n: c for n, c in histogram.items() if c}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    sizes: list[int] = []
    total = 0

    def put(length: int, many: int, sequence: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + many, sequence, offset))
        rank[length] += many
        left[length] -= many

    def gap(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in gaps:
                insort(sizes, room)
            gaps.setdefault(room, []).append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at < 0:
            many, used = left[n], n
            put(n, many, total, 0)
        elif large[at] != n:
            many, used = min(left[n], left[large[at]]), n + large[at]
            put(n, many, total, 0)
            put(large[at], many, total, n)
        elif left[n] > 1:
            many, used = left[n] // 2, 2 * n
            put(n, many, total, 0)
            put(n, many, total, n)
        elif at:
            many, used = 1, n + large[at - 1]
            put(n, 1, total, 0)
            put(large[at - 1], 1, total, n)
        else:
            many, used = 1, n
            put(n, 1, total, 0)
        gap(capacity - used, total, many)
        total += many
        large = [x for x in large if left[x]]
    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at < len(sizes):
                room = sizes[at]
                first, many = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], sizes[at]
            else:
                room, first = capacity, total
                many = -(-left[n] // (capacity // n))
                total += many
            each = room // n
            full = min(many, left[n] // each)
            for k in range(each if full else 0):
                put(n, full, first, capacity - room + k * n)
            gap(room - each * n, first, full)
            if full < many:
                more = min(each, left[n]) if left[n] else 0
                for k in range(more):
                    put(n, 1, first + full, capacity - room + k * n)
                gap(room - more * n, first + full, 1 if more else 0)
                rest = full + (1 if more else 0)
                gap(room, first + rest, many - rest)
    return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    found = written(pieces(docs, vocabulary, capacity, end_id), "pieces")
    bucketed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    counts = [(r[0], r[1], r[2]) for r in bucketed.groupBy("length", "bucket").count().collect()]  # at most capacity x BUCKETS
    histogram: dict[int, int] = {}
    before = []
    for n, b, c in sorted(counts):
        before.append((n, b, histogram.get(n, 0)))
        histogram[n] = histogram.get(n, 0) + c
    offsets = spark.createDataFrame(before, "length long, bucket long, before long")
    places = spark.createDataFrame(plan(histogram, capacity), "length long, lo long, hi long, sequence long, offset long")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = bucketed.withColumn("rn", F.row_number().over(order)).join(F.broadcast(offsets), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    p = F.broadcast(places.withColumnRenamed("length", "place_length"))
    return ranked.join(p, (F.col("length") == F.col("place_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


__all__ = ["pack", "pieces", "plan", "query", "tasks"]
