"""Katz back-off language model of word pairs with Good-Turing discounts, fitted and evaluated over whole tables.

Words are runs of other bytes than white space (9-13 and 32), A-Z folded; every text ends with one end word. A word
seen c times in training has probability d_c * c / N, where d_c is Good-Turing's discount for c up to K; what the
discounts leave is the probability of any unseen word. After a context h a seen pair has d'_c * c / c(h), any other
word a(h) times its own probability, and a(h) = (1 - sum of the seen pairs) / (1 - sum of the seen words' own
probabilities), so each context sums to one exactly. A context whose counts all exceed K gets c(h) + 1 for c(h). A
context that training lacks backs off with weight one.

Texts become compressed batches, written once, and meet only the answers to their own batch. Each batch asks the partition of a word
(by hash range) or of a context (by hash) with sorted arrays of what it holds and its training counts, each entry
once; the partition merges them, keeps its part of the count table (kind `table`, a Parquet table by partition), and
answers each batch entry by entry. So the load of a partition depends on distinct entries and not on how often a word
stands in the texts, and no vocabulary goes to the driver or is broadcast: the driver sees the sums N, V and the
counts of counts up to K + 1.

Edge cases: null text counts as empty (the end word alone); a null doc_id is in training; repeated rows count as
often as they stand; without training rows every score is 0; an empty table gives an empty result; further columns
are ignored. Words are told apart by 64-bit hashes; numbers of words take 32 bits in messages, 64 from NARROW words on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import join_texts, mix, words
from .common import read, tasks, whole, written

K, BATCH_BYTES, PART_BATCHES, NARROW = 5, 12_000_000, 4, 2**32 - 1
END = np.uint64(0x656E64)
MESSAGE = "batch long, part int, kind string, a binary, b binary, c binary, d binary, e binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(x: np.ndarray) -> bytes:
    """Compressed array; the bytes of equal rank stand together, so that leading zeros cost nothing."""
    x = np.ascontiguousarray(x)
    planes = x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T if x.itemsize > 1 else x
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind) if size > 1 else raw.view(kind)


def packed_text(data: np.ndarray) -> bytes:
    """Compressed text; copies far apart are found too."""
    how = zstandard.ZstdCompressionParameters.from_level(3, enable_ldm=True, window_log=24)
    return zstandard.ZstdCompressor(compression_params=how).compress(data.tobytes())


def unpacked_text(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor(max_window_size=1 << 27).decompress(b), dtype=np.uint8)


def parts_of(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the hash ranges of all partitions in a sorted array (parts + 1 entries)."""
    cuts = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, cuts), [len(sorted_hashes)]])


def batched(docs: DataFrame) -> DataFrame:
    """One row per batch of texts: a: the texts, b: their offsets, d: doc_ids, e: first bit for texts held out, second
    for null ids."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size, k
            data, offsets = join_texts([h[0] for h in held])
            flags = np.array([bool(h[2]) + 2 * (h[1] is None) for h in held], dtype=np.uint8)
            row = ((task << 32) + k, 0, "text", packed_text(data), packed(offsets), None, packed(np.array([h[1] or 0 for h in held], dtype=np.int64)), packed(flags))
            held, size, k = [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ARROW, strict=True)], schema=ARROW)

        for b in batches:
            for i in range(b.num_rows):  # one text at a time: a batch of long ones is large as Python objects
                held.append(tuple(c[i].as_py() for c in b.columns))
                size += len(held[-1][0])
                if size >= BATCH_BYTES:
                    yield flush()
        if held:
            yield flush()

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return docs.select(whole("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held")).mapInArrow(run, MESSAGE)


ARROW = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), *[(c, pa.binary()) for c in "abcde"]])


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=ARROW.names).astype({"batch": "int64", "part": "int32"})


class Batch:
    """A batch of texts: tokens as numbers of its sorted words; every text's last token is the end word."""

    def __init__(self, row):
        hashes, _, _, first = words(unpacked_text(row.a), unpacked(row.b, "<i8"))
        self.n = np.diff(first) + 1
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        tokens = np.full(self.first[-1], END, dtype=np.uint64)
        inside = np.ones(len(tokens), dtype=bool)
        inside[self.first[1:] - 1] = False
        tokens[inside] = hashes
        self.words, number = np.unique(tokens, return_inverse=True)
        self.number = number.astype(np.uint32)
        self.ids = unpacked(row.d, np.int64)
        flags = unpacked(row.e, np.uint8)
        self.held, self.null = (flags & 1).astype(bool), (flags & 2).astype(bool)
        self.trains = np.repeat(~self.held, self.n)

    def answered(self, replies: pd.DataFrame, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and global number of each word of the batch. base: numbers that come before each partition's."""
        replies = replies.sort_values("part")
        count = np.concatenate([unpacked(x, "<u8") for x in replies["a"]] or [np.zeros(0, np.uint64)]).astype(np.int64)
        number = np.concatenate([np.cumsum(unpacked(x, "<u4").astype(np.int64)) + base[p] for p, x in zip(replies["part"], replies["b"], strict=True)] or [np.zeros(0, np.int64)])
        return count, number


def distinct_pairs(context: np.ndarray, follow: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by context, then follower; the first place of each and the number of each row's pair."""
    if not wide:
        keys, first, place = np.unique((context.astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64), return_index=True, return_inverse=True)
        return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), first, place
    order = np.lexsort((follow, context))
    c, f = context[order], follow[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (c[1:] != c[:-1]) | (f[1:] != f[:-1])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return c[new], f[new], order[new], place


class Pairs:
    """Distinct contexts and pairs of a batch whose words training knows, in the order of their partitions."""

    def __init__(self, batch: Batch, count: np.ndarray, number: np.ndarray, start: int, parts: int, wide: bool):
        ids = np.where(count > 0, number, -1)[batch.number]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[batch.first[:-1]] = start
        self.token_count = count[batch.number]
        self.context_of = before
        contexts = np.unique(before)
        contexts = contexts[contexts >= 0]
        part = part_of(contexts, parts)
        self.contexts = contexts[np.argsort(part, kind="stable")]
        self.context_bounds = np.searchsorted(np.sort(part), np.arange(parts + 1))
        both = (before >= 0) & (ids >= 0)
        self.known = both
        of, follow, first, self.place = distinct_pairs(before[both], ids[both], wide)
        self.counts = np.bincount(self.place, batch.trains[both], len(of)).astype(np.uint32)
        part = part_of(of, parts)
        self.order = np.argsort(part, kind="stable")
        self.of, self.follow = of[self.order], follow[self.order]
        self.bounds = np.searchsorted(np.sort(part), np.arange(parts + 1))
        self.own_count = self.token_count[both][first][self.order]


def part_of(contexts: np.ndarray, parts: int) -> np.ndarray:
    return (mix(contexts.astype(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.uint32)


def discounts(counts_of: np.ndarray) -> np.ndarray:
    """Good-Turing's discounts of counts 0..K (entry 0 unused); counts_of[r]: how many have count r, r <= K + 1.
    Where they leave (0, 1] (small or odd data), half a count is taken off instead."""
    n = counts_of.astype(float)
    r = np.arange(1, K + 1)
    half = (r - 0.5) / r
    if n[1] <= 0:
        return np.concatenate([[1.0], half])
    cut = (K + 1) * n[K + 1] / n[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = ((r + 1) * n[2 : K + 2] / (r * n[1 : K + 1]) - cut) / (1 - cut)
    return np.concatenate([[1.0], np.where(np.isfinite(d) & (d > 0) & (d < 1), d, half)])


class Unigram:
    """Own probability of words by their training count."""

    def __init__(self, tokens: int, counts_of: np.ndarray):
        self.tokens = tokens
        self.d = discounts(counts_of)
        r = np.arange(1, K + 1)
        left = float((counts_of[1 : K + 1] * r * (1 - self.d[1:])).sum()) / max(tokens, 1)
        self.scale = 1.0 if left > 0 else tokens / (tokens + 1)
        self.unseen = left if left > 0 else 1 - self.scale

    def __call__(self, count: np.ndarray) -> np.ndarray:
        d = np.where(count <= K, self.d[np.minimum(count, K)], 1.0)
        return np.where(count > 0, self.scale * d * count / max(self.tokens, 1), self.unseen)


def ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for row in b.to_pandas().itertuples():
                batch = Batch(row)
                count = np.bincount(batch.number, batch.trains, len(batch.words)).astype("<u4")
                at = parts_of(batch.words, parts)
                rows = [(row.batch, p, "ask", batch.words[at[p] : at[p + 1]].tobytes(), packed(count[at[p] : at[p + 1]]), None, None, None) for p in range(parts) if at[p] < at[p + 1]]
                yield pa.RecordBatch.from_pandas(frame(rows), schema=ARROW, preserve_index=False)

    return run


def counts_of(totals: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(totals, K + 2), minlength=K + 3)[: K + 2].astype("<i8")


def merge_words(rows: pd.DataFrame) -> pd.DataFrame:
    """Answers (a: training counts, b: steps of the word's number) and the partition's table (a: hashes, b: counts) with
    its sums (c: tokens, words, numbers given; d: counts of counts)."""
    part = int(rows["part"].iloc[0])
    hashes = [np.frombuffer(x, np.uint64) for x in rows["a"]]
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, np.concatenate([unpacked(x, "<u4") for x in rows["b"]]), len(known)).astype(np.int64)
    out, at = [], 0
    for batch, h in zip(rows["batch"], hashes, strict=True):
        own = place[at : at + len(h)]
        at += len(h)
        out.append((batch, part, "word", packed(total[own].astype("<u8")), packed(np.diff(own, prepend=0).astype("<u4")), None, None, None))
    sums = np.array([total.sum(), (total > 0).sum(), len(known)], dtype="<i8")
    out.append((-1, part, "table", packed(known), packed(total.astype("<u8")), sums.tobytes(), counts_of(total).tobytes(), None))
    return frame(out)


def ask_pairs(parts: int, base: np.ndarray, start: int):
    wide = start >= NARROW
    kind = "<u8" if wide else "<u4"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        text = rows[rows["kind"] == "text"].iloc[0]
        batch = Batch(text)
        count, number = batch.answered(rows[rows["kind"] == "word"], base)
        p = Pairs(batch, count, number, start, parts, wide)
        counts = p.counts[p.order]
        out = []
        for k in range(parts):
            c = p.contexts[p.context_bounds[k] : p.context_bounds[k + 1]]
            if not len(c):
                continue
            own = slice(p.bounds[k], p.bounds[k + 1])
            sizes = np.bincount(np.searchsorted(c, p.of[own]), minlength=len(c))
            out.append((text["batch"], k, "ask", packed(np.diff(c, prepend=0).astype(kind)), packed(sizes.astype("<u4")), packed(np.diff(p.follow[own], prepend=0).astype(kind)), packed(counts[own]), packed(p.own_count[own].astype("<u8"))))
        return frame(out)

    return run


def merge_pairs(unigram: Unigram, wide: bool):
    kind = "<u8" if wide else "<u4"
    numbers = lambda x: np.cumsum(unpacked(x, kind), dtype=kind).astype(np.int64)  # noqa: E731  differences wrap round

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Answers (a: counts of the asked pairs, b: of each context: its count and its pairs of count 1..K, c: the sum
        of its seen words' own probabilities) and the table (a: contexts, b: pairs of each, c: followers, d: counts;
        e: counts of counts)."""
        part = int(rows["part"].iloc[0])
        asked = []
        for r in rows.itertuples():
            c = numbers(r.a)
            asked.append((c, np.repeat(c, unpacked(r.b, "<u4").astype(np.int64)), numbers(r.c), unpacked(r.d, "<u4"), unpacked(r.e, "<u8")))
        whole_of, whole_follow, first, place = distinct_pairs(*(np.concatenate([x[k] for x in asked]) for k in (1, 2)), wide)
        total = np.bincount(place, np.concatenate([x[3] for x in asked]), len(whole_of)).astype(np.int64)
        own = np.concatenate([x[4] for x in asked])[first].astype(np.int64)
        contexts = np.unique(np.concatenate([x[0] for x in asked]))
        seen = np.flatnonzero(total > 0)
        of = np.searchsorted(contexts, whole_of[seen])
        n = len(contexts)
        of_context = np.stack([np.bincount(of, total[seen], n), *[np.bincount(of, total[seen] == r, n) for r in range(1, K + 1)]]).astype("<i8")
        lower = np.bincount(of, unigram(own[seen]), n)
        out, at = [], 0
        for batch, (c, k, *_) in zip(rows["batch"], asked, strict=True):
            mine = place[at : at + len(k)]
            at += len(k)
            where = np.searchsorted(contexts, c)
            out.append((batch, part, "pair", packed(total[mine].astype("<u8")), packed(of_context[:, where]), packed(lower[where]), None, None))
        table = (packed(np.diff(contexts, prepend=0).astype(kind)), packed(np.bincount(of, minlength=n).astype("<u4")), packed(np.diff(whole_follow[seen], prepend=0).astype(kind)), packed(total[seen].astype("<u4")), counts_of(total[seen]).tobytes())
        out.append((-1, part, "table", *table))
        return frame(out)

    return run


def evaluate(parts: int, base: np.ndarray, start: int, distinct: int, unigram: Unigram, d: np.ndarray):
    wide = start >= NARROW

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(rows[rows["kind"] == "text"].iloc[0])
        count, number = batch.answered(rows[rows["kind"] == "word"], base)
        p = Pairs(batch, count, number, start, parts, wide)
        replies = rows[rows["kind"] == "pair"].sort_values("part")
        own = unigram(p.token_count)
        probability = own.copy()
        if len(replies):
            c = np.concatenate([unpacked(x, "<u8") for x in replies["a"]]).astype(np.int64)
            stats = np.concatenate([unpacked(x, "<i8").reshape(K + 1, -1) for x in replies["b"]], axis=1)
            lower = np.concatenate([unpacked(x, np.float64) for x in replies["c"]])
            r = np.arange(1, K + 1)
            taken = (stats[1:] * (r * (1 - d[1:]))[:, None]).sum(axis=0)
            of_all = stats[0] + (taken <= 0)
            left = np.where(taken > 0, taken, 1.0) / np.maximum(of_all, 1)
            seen = stats[0] > 0
            weight = np.where(seen, left / np.maximum(1 - lower, 1e-300), 1.0)
            by_context = np.argsort(p.contexts)
            there = p.context_of >= 0
            at = by_context[np.searchsorted(p.contexts, p.context_of[there], sorter=by_context)]
            probability[there] *= weight[at]
            full = np.zeros(len(p.context_of))
            full[there] = of_all[at]
            back = np.empty(len(c), dtype=np.int64)
            back[p.order] = np.arange(len(c))
            pair = np.zeros(len(p.context_of), dtype=np.int64)
            pair[p.known] = c[back[p.place]]
            hit = pair > 0
            probability[hit] = np.where(pair[hit] <= K, d[np.minimum(pair[hit], K)], 1.0) * pair[hit] / full[hit]
        add = lambda x: np.add.reduceat(x, batch.first[:-1])  # noqa: E731  no text is without its end word
        tokens = unigram.tokens
        with np.errstate(divide="ignore"):
            score, plain = np.log10(probability), np.log10((p.token_count + 1) / (tokens + distinct + 1))
        ids = pd.array(batch.ids, dtype="Int64")
        ids[batch.null] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": batch.held, "n_tokens": batch.n, "n_known": add((p.token_count > 0).astype(np.int64)), "train_tokens": tokens, "base_score": add(plain), "score": add(score) if tokens else 0.0})

    return run


def scored(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    texts = written(batched(docs), "batches", tidy=True)
    # a part, which one task holds at a time, for the words of a few batches; each is a shuffle partition of its own
    parts = max(tasks(spark), texts.count() // PART_BATCHES)
    by_part = lambda asks: asks.repartitionById(parts, "part").groupBy("part")
    by_word = written(by_part(texts.mapInArrow(ask_words(parts), MESSAGE)).applyInPandas(merge_words, MESSAGE), "words", tidy=True)
    tables = by_word.filter("kind = 'table'").select("part", "c", "d").collect()  # a few numbers for each partition
    sums = {r["part"]: np.frombuffer(r["c"], "<i8") for r in tables}
    tokens, distinct = (int(sum(s[k] for s in sums.values())) for k in (0, 1))
    base = np.concatenate([[0], np.cumsum([int(sums[p][2]) if p in sums else 0 for p in range(parts)])])
    start = int(base[-1])
    unigram = Unigram(tokens, sum((np.frombuffer(r["d"], "<i8") for r in tables), np.zeros(K + 2, dtype=np.int64)))
    words_of = by_word.filter("kind = 'word'")
    asks = texts.unionByName(words_of).groupBy("batch").applyInPandas(ask_pairs(parts, base, start), MESSAGE)
    by_pair = written(by_part(asks).applyInPandas(merge_pairs(unigram, start >= NARROW), MESSAGE), "pairs", tidy=True)
    of = by_pair.filter("kind = 'table'").select("e").collect()  # K + 2 numbers for each partition
    d = discounts(sum((np.frombuffer(r["e"], "<i8") for r in of), np.zeros(K + 2, dtype=np.int64)))
    rows = texts.unionByName(words_of).unionByName(by_pair.filter("kind = 'pair'"))
    return rows.groupBy("batch").applyInPandas(evaluate(parts, base, start, distinct, unigram, d), RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))
