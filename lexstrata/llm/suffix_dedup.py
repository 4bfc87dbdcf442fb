"""Removal of repeated passages by suffix arrays over byte shards.

Every byte that some LENGTH-byte string covers goes, if that string also starts at another place of the corpus.
Any such string has an anchor: a K-byte piece with the least hash of all its pieces, which every copy of the string
has at the same place. So copies meet at anchors:

1. Texts become shards, written once, with the places of their anchors. Each shard asks the partition of an anchor's
   hash once per distinct (anchor, context); the context is all that strings with this anchor can reach. An anchor
   with one context that stands once is alone; a context that stands twice or more is covered whole; contexts that
   stand once beside other contexts of their anchor need the suffix arrays, and one shard sends each of those.
2. A partition of contexts sorts the texts that follow its anchors, and those that precede them (backwards), into two
   sparse suffix arrays: groups of equal prefix are refined eight bytes at a time, and only groups still unsorted are
   sorted again, after Larsson and Sadakane. Common prefixes of neighbours come with the refinement, as Kasai's pass
   would give them. For each start of a string relative to the anchor the arrays cut at two depths give classes of
   equal texts before and after; contexts in the same pair of classes share the string. All strings found for one
   context hold the anchor, so the answer is one interval.
3. An anchor with more than HOT contexts (a passage in a third of all documents, say) is not gathered: each shard
   sorts the strings of its own contexts and sends one digest per class, cut by hash range; partitions merge the
   sorted runs by binary search and answer which occur twice. Their load follows distinct strings per shard.

Suffixes start at anchors only, not at every byte: full arrays of all shards, merged pairwise, would need every pair
of shards, and a shuffle of all suffixes many times the input. The result is the same.

Edge cases: null text counts as empty; texts under LENGTH bytes lose nothing; repeated rows are documents of their
own (and remove each other, from LENGTH bytes on); ids may be null or repeat; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BASE_INVERSE, join_texts, mix, powers, prefix_hash, span_hash, window_extreme
from .common import read, tasks, whole, written
from .language_model import ARROW, MESSAGE, frame, packed, packed_text, parts_of, unpacked, unpacked_text

LENGTH, K, SHARD_BYTES, PART_SHARDS, CHUNK, HOT = 400, 100, 2_000_000, 8, 1 << 16, 16384
WINDOW, LEFT = LENGTH - K + 1, LENGTH - K
NONE = np.uint64(2**64 - 1)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: What an anchor's partition answers for a context.
ALONE, COVERED, SEND, COVERED_SEND, HOT_SEND, HOT_COVERED_SEND = range(6)


def anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of all K-byte pieces that have the least hash of some run of WINDOW pieces."""
    n = len(data) - K + 1
    out = [np.zeros(0, dtype=np.int64)]
    ends = offsets[1:] - 1
    for s in range(0, max(n, 0), CHUNK):
        c = min(CHUNK, n - s)
        lo, hi = max(0, s - WINDOW + 1), min(n, s + c + WINDOW - 1)
        p = prefix_hash(data[lo : hi + K - 1])
        h = mix((p[K:] - p[:-K]) * powers(BASE_INVERSE, len(p))[: hi - lo])
        for e in ends[np.searchsorted(ends, lo) : np.searchsorted(ends, hi + K - 1)]:  # pieces that pass a text's end
            h[max(0, e - K + 1 - lo) : max(0, e + 1 - lo)] = NONE
        h = np.concatenate([np.full(WINDOW - 1 - (s - lo), NONE), h, np.full(WINDOW - 1 - (hi - s - c), NONE)])
        most = window_extreme(window_extreme(h, WINDOW, np.minimum), WINDOW, np.maximum)
        own = h[WINDOW - 1 : WINDOW - 1 + c]
        out.append(np.flatnonzero((most == own) & (own != NONE)) + s)
    return np.concatenate(out)


class Shard:
    """A shard's texts, and its anchors with their contexts; `distinct` (anchor, context) pairs in order of their hashes."""

    def __init__(self, row):
        self.data = unpacked_text(row.a)
        self.offsets = unpacked(row.b, "<i8")
        self.ids, self.null = unpacked(row.c, np.int64), unpacked(row.d, np.uint8).astype(bool)
        at = np.cumsum(unpacked(row.e, "<u4").astype(np.int64))
        doc = np.searchsorted(self.offsets, at, side="right") - 1
        lo, hi = np.maximum(at - LEFT, self.offsets[doc]), np.minimum(at + LENGTH, self.offsets[doc + 1] - 1)
        fit = hi - lo >= LENGTH
        self.at, self.lo, self.hi = at[fit], lo[fit], hi[fit]
        self.prefix = prefix_hash(self.data)
        # least hashes all lie low: mixed again, so that ranges of them are even
        self.anchor = mix(span_hash(self.prefix, self.at, self.at + K))
        self.context = mix(span_hash(self.prefix, self.lo, self.hi) ^ (self.at - self.lo).astype(np.uint64))
        order = np.lexsort((self.context, self.anchor))
        a, c = self.anchor[order], self.context[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.pair = np.empty(len(order), dtype=np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.distinct = order[new]  # one occurrence of each pair
        self.many = np.bincount(self.pair, minlength=len(self.distinct))

    def codes(self, replies: pd.DataFrame) -> np.ndarray:
        replies = replies.sort_values("part")
        return np.concatenate([unpacked(x, np.uint8) for x in replies["a"]] or [np.zeros(0, np.uint8)])

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of all strings of some contexts, and where they start."""
        first, last = self.lo[which], self.hi[which] - LENGTH
        many = last - first + 1
        of = np.repeat(np.arange(len(which)), many)
        start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[of]
        digest = mix(span_hash(self.prefix, start, start + LENGTH) ^ self.anchor[which][of])
        return digest, start

    def in_steps(self, which: np.ndarray, step: int = 1000):
        """strings() of some contexts at a time, so that memory is bounded however many are hot."""
        for k in range(0, len(which), step):
            yield self.strings(which[k : k + step])


def sharded(docs: DataFrame) -> DataFrame:
    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        texts: list[str] = []
        ids: list[int | None] = []
        size = 0

        def flush():
            nonlocal texts, ids, size, k
            data, offsets = join_texts(texts)
            at = anchors(data, offsets)
            row = ((task << 32) + k, 0, "text", packed_text(data), packed(offsets), packed(np.array([i or 0 for i in ids], dtype=np.int64)), packed(np.array([i is None for i in ids], dtype=np.uint8)), packed(np.diff(at, prepend=0).astype("<u4")))
            texts, ids, size, k = [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ARROW, strict=True)], schema=ARROW)

        for b in batches:
            for r in range(b.num_rows):
                t, i = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                if texts and size + len(t) > SHARD_BYTES:
                    yield flush()
                texts.append(t)
                ids.append(i)
                size += len(t.encode("utf-8", "surrogatepass")) + 1
        if texts:
            yield flush()

    return docs.select(whole("text").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, MESSAGE)


def ask_anchors(parts: int):
    def run(batches):
        for b in batches:
            for row in b.to_pandas().itertuples():
                s = Shard(row)
                a, c, many = s.anchor[s.distinct], s.context[s.distinct], np.minimum(s.many, 2).astype(np.uint8)
                at = parts_of(a, parts)
                rows = [(row.batch, p, "ask", a[at[p] : at[p + 1]].tobytes(), c[at[p] : at[p + 1]].tobytes(), packed(many[at[p] : at[p + 1]]), None, None) for p in range(parts) if at[p] < at[p + 1]]
                yield pa.RecordBatch.from_pandas(frame(rows), schema=ARROW, preserve_index=False)

    return run


def judge_anchors(hot: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        pieces = [np.frombuffer(x, np.uint64) for x in rows["a"]]
        a, c = np.concatenate(pieces), np.concatenate([np.frombuffer(x, np.uint64) for x in rows["b"]])
        many = np.concatenate([unpacked(x, np.uint8) for x in rows["c"]]).astype(np.int64)
        order = np.lexsort((c, a))
        sa, sc = a[order], c[order]
        new_a = np.ones(len(sa), dtype=bool)
        new_a[1:] = sa[1:] != sa[:-1]
        new_c = new_a.copy()
        new_c[1:] |= sc[1:] != sc[:-1]
        context = np.cumsum(new_c) - 1
        total = np.bincount(context, many[order])
        of_anchor = np.cumsum(new_a) - 1
        contexts = np.bincount(of_anchor, new_c)[of_anchor]
        covered = total[context] > 1
        mixed = contexts > 1
        code = np.where(covered, COVERED, ALONE)
        # of a covered context one shard sends the text, for the others of its anchor
        code = np.where(mixed & new_c, np.where(contexts > hot, HOT_SEND, SEND) + covered, code)
        out = np.empty(len(a), dtype=np.uint8)
        out[order] = code
        rows_out, at = [], 0
        for batch, x in zip(rows["batch"], pieces, strict=True):
            rows_out.append((batch, part, "code", packed(out[at : at + len(x)]), None, None, None, None))
            at += len(x)
        return frame(rows_out)

    return run


def send(parts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        text = rows[rows["kind"] == "text"].iloc[0]
        s = Shard(text)
        code = s.codes(rows[rows["kind"] == "code"])
        out = []
        which = s.distinct[(code == SEND) | (code == COVERED_SEND)]
        asks = code[(code == SEND) | (code == COVERED_SEND)] == SEND
        at = parts_of(s.anchor[which], parts)
        for p in range(parts):
            w = which[at[p] : at[p + 1]]
            if len(w):
                body = np.concatenate([s.data[i:j] for i, j in zip(s.lo[w], s.hi[w], strict=True)])
                sizes = np.stack([s.at[w] - s.lo[w], s.hi[w] - s.at[w], asks[at[p] : at[p + 1]]]).astype("<u2")
                out.append((text["batch"], p, "context", s.anchor[w].tobytes(), packed(sizes), packed(body), None, None))
        hot = s.distinct[(code == HOT_SEND) | (code == HOT_COVERED_SEND)]
        if len(hot):
            digest, start = (np.concatenate(x) for x in zip(*s.in_steps(hot), strict=True))
            order = np.lexsort((start, digest))
            digest, start = digest[order], start[order]
            new = np.ones(len(digest), dtype=bool)
            new[1:] = (digest[1:] != digest[:-1]) | (start[1:] != start[:-1])  # an anchor that stands twice in a string lists it twice
            known, many = np.unique(digest[new], return_counts=True)
            many = np.minimum(many, 2).astype(np.uint8)
            at = parts_of(known, parts)
            out += [(text["batch"], p, "string", known[at[p] : at[p + 1]].tobytes(), packed(many[at[p] : at[p + 1]]), None, None, None) for p in range(parts) if at[p] < at[p + 1]]
        return frame(out)

    return run


def suffix_order(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (group, text), and for each place of it the common prefix with the row before (-1: another group).

    text: rows of bytes, padded with 255 (no UTF-8 byte), a multiple of eight wide."""
    n, width = text.shape
    keys = np.ascontiguousarray(text).view(">u8").astype(np.uint64).reshape(n, width // 8)
    order = np.argsort(group, kind="stable")
    common = np.full(n, width, dtype=np.int64)
    g = group[order]
    common[0:1] = -1
    common[1:][g[1:] != g[:-1]] = -1
    for k in range(width // 8):
        head = common < width  # heads of groups; rows of groups with two or more are still unsorted
        unsorted = ~(head & np.append(head[1:], True))
        at = np.flatnonzero(unsorted)
        if not len(at):
            break
        rank = np.cumsum(head)[at]
        key = keys[order[at], k]
        by = np.lexsort((key, rank))
        order[at] = order[at][by]
        key = key[by]
        split = np.zeros(len(at), dtype=bool)
        split[1:] = (key[1:] != key[:-1]) & (rank[1:] == rank[:-1])
        differ = key[split] ^ key[np.flatnonzero(split) - 1]
        equal = sum((differ < np.uint64(1 << (56 - 8 * i))).astype(np.int64) for i in range(7))
        common[at[split]] = 8 * k + equal
    return order, common


def cut(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Class of each row: rows of equal group whose texts agree for `depth` bytes."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def table(body: np.ndarray, first: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of bytes body[first], body[first + step], .. of the given sizes, padded with 255."""
    out = np.full((len(first), width), 255, dtype=np.uint8)
    for k in range(0, len(first), 2000):  # some rows at a time: index arrays are eight times the bytes
        f, n = first[k : k + 2000, None], size[k : k + 2000, None]
        place = np.arange(width)[None, :]
        there = place < n
        out[k : k + 2000][there] = body[(f + step * place)[there]]
    return out


def shared_strings(anchor: np.ndarray, body: np.ndarray, middle: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and greatest number of bytes before its anchor at which a string that another
    context shares starts; -1 if there is none. middle: where the anchor stands in body, with n_left bytes of context
    before it and n_right from it on."""
    n = len(anchor)
    before = table(body, middle - 1, n_left, -(-LEFT // 8) * 8, -1)
    after = table(body, middle, n_right, LENGTH, 1)
    group = np.unique(anchor, return_inverse=True)[1]
    back, ahead = suffix_order(group, before), suffix_order(group, after)
    least, greatest = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
    for start in range(LEFT + 1):
        fit = np.flatnonzero((n_left >= start) & (n_right >= LENGTH - start))
        key = cut(*back, start)[fit] * (n + 1) + cut(*ahead, LENGTH - start)[fit]
        by = np.argsort(key, kind="stable")
        k = key[by]
        same = np.zeros(len(k) + 1, dtype=bool)
        same[1:-1] = k[1:] == k[:-1]
        hit = fit[by[same[1:] | same[:-1]]]
        least[hit] = np.where(least[hit] < 0, start, least[hit])
        greatest[hit] = start
    return least, greatest


def slabs(anchor: np.ndarray, most: int = 8192):
    """Index arrays of about `most` contexts each; those of one anchor (HOT at most) stay together."""
    order = np.argsort(anchor, kind="stable")
    ends = np.append(np.flatnonzero(anchor[order][1:] != anchor[order][:-1]) + 1, len(order))
    begin = 0
    while begin < len(order):
        end = int(ends[max(np.searchsorted(ends, begin + most, side="right") - 1, np.searchsorted(ends, begin, side="right"))])
        yield order[begin:end]
        begin = end


def merge(rows: pd.DataFrame) -> pd.DataFrame:
    part = int(rows["part"].iloc[0])
    out = []
    contexts = rows[rows["kind"] == "context"]
    if len(contexts):
        anchor = np.concatenate([np.frombuffer(x, np.uint64) for x in contexts["a"]])
        sizes = [unpacked(x, "<u2").reshape(3, -1).astype(np.int64) for x in contexts["b"]]
        asks = [x[2].astype(bool) for x in sizes]
        n_left, n_right = (np.concatenate([x[k] for x in sizes]) for k in (0, 1))
        body = np.concatenate([unpacked(x, np.uint8) for x in contexts["c"]])
        middle = np.cumsum(n_left + n_right) - n_right
        least, greatest = np.full(len(anchor), -1, dtype=np.int32), np.full(len(anchor), -1, dtype=np.int32)
        for own in slabs(anchor):
            least[own], greatest[own] = shared_strings(anchor[own], body, middle[own], n_left[own], n_right[own])
        del body
        at = 0
        for batch, own in zip(contexts["batch"], asks, strict=True):
            place = np.flatnonzero(own) + at
            at += len(own)
            out.append((batch, part, "reach", packed(np.stack([least[place], greatest[place]]).astype("<i2")), None, None, None, None))
    strings = rows[rows["kind"] == "string"]
    if len(strings):
        runs = [np.frombuffer(x, np.uint64) for x in strings["a"]]
        many = np.concatenate([unpacked(x, np.uint8) for x in strings["b"]])
        known, place = np.unique(np.concatenate(runs), return_inverse=True)
        twice = known[np.bincount(place, many) > 1]
        for batch, r in zip(strings["batch"], runs, strict=True):
            at = np.minimum(np.searchsorted(twice, r), max(len(twice) - 1, 0))
            found = twice[at] == r if len(twice) else np.zeros(len(r), dtype=bool)
            out.append((batch, part, "twice", packed(found), None, None, None, None))
    return frame(out)


def remove(rows: pd.DataFrame) -> pd.DataFrame:
    s = Shard(rows[rows["kind"] == "text"].iloc[0])
    code = s.codes(rows[rows["kind"] == "code"])
    change = np.zeros(len(s.data) + 1, dtype=np.int32)

    def cover(lo, hi):
        np.add.at(change, lo, 1)
        np.subtract.at(change, hi, 1)

    whole_ = np.isin(code, (COVERED, COVERED_SEND, HOT_COVERED_SEND))[s.pair]
    cover(s.lo[whole_], s.hi[whole_])
    reach = [unpacked(x, "<i2").reshape(2, -1).astype(np.int64) for x in rows[rows["kind"] == "reach"].sort_values("part")["a"]]
    if reach:
        least, greatest = np.concatenate(reach, axis=1)
        at, hit = s.at[s.distinct[code == SEND]], least >= 0
        cover((at - greatest)[hit], (at - least + LENGTH)[hit])
    twice = [unpacked(x, bool) for x in rows[rows["kind"] == "twice"].sort_values("part")["a"]]
    if twice:
        hot = s.distinct[(code == HOT_SEND) | (code == HOT_COVERED_SEND)]
        found = np.concatenate(twice)
        known = np.unique(np.concatenate([d for d, _ in s.in_steps(hot)]))[found]
        for digest, start in s.in_steps(hot) if len(known) else []:
            own = start[known[np.minimum(np.searchsorted(known, digest), len(known) - 1)] == digest]
            cover(own, own + LENGTH)
    gone = np.cumsum(change[:-1]) > 0
    out = []
    for k, i in enumerate(s.ids):
        a, b = s.offsets[k], s.offsets[k + 1] - 1
        g = gone[a:b]
        n = int(g.sum())
        runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0
        out.append((b - a, n, runs, sha256(s.data[a:b][~g].tobytes() if n else s.data[a:b].tobytes()).hexdigest()))
    ids = pd.array(s.ids, dtype="Int64")
    ids[s.null] = pd.NA
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(doc_id=ids)[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]]


def deduplicated(docs: DataFrame) -> DataFrame:
    shards = written(sharded(docs), "shards", tidy=True)
    # a part, which one task holds at a time, for the anchors of a few shards; each is a shuffle partition of its own
    parts = max(2 * tasks(docs.sparkSession), shards.count() // PART_SHARDS)
    by_part = lambda asks: asks.repartitionById(parts, "part").groupBy("part")
    codes = written(by_part(shards.mapInArrow(ask_anchors(parts), MESSAGE)).applyInPandas(judge_anchors(HOT), MESSAGE), "codes", tidy=True)
    both = shards.unionByName(codes)
    found = written(by_part(both.groupBy("batch").applyInPandas(send(parts), MESSAGE)).applyInPandas(merge, MESSAGE), "found", tidy=True)
    return both.unionByName(found).groupBy("batch").applyInPandas(remove, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"))
