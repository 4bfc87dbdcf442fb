"""Near-duplicate groups by Order MinHash with verification by banded alignment.

A document's words (white-space separated, A-Z folded) give shingles of five words, each labelled with its occurrence
number. For each of BANDS samples the PICK labelled shingles with the least hashes are taken and hashed in the order
in which they stand in the text, so a sample agrees for texts of small edit distance. Texts that are equal as word
sequences form one node. In a bucket (equal sample) each member is verified with the bucket's leader, the least
member in an order that is the same in all buckets.

Verification aligns the two sequences: equal labelled shingles whose places differ by no more than the band (the most
that the required similarity allows) are chained by the longest increasing subsequence. The words under the chain's
shingles are aligned; with m of them the similarity is m / (n1 + n2 - m) words, and SIMILAR or more links the texts.
So a replaced word costs that word, not the five shingles over it.

Buckets whose members are not yet of one class stay open. Their members first meet the member whose shingles are the
most frequent among open texts (in a family of copies the one nearest to the original). The pairs of different
classes that are left are settled without listing them. Of two similar texts either has at most `spare` words that
are not aligned, a ninth of its words if both are of one length; so of any `spare` + 1 of its words one lies under a shared shingle.
Each open text has the words whose shingles are rarest, in that order, and of two texts the one whose last such word
is rarer asks with the shingles over them. It meets the classes that have such a shingle, and only the texts of those
classes that have it are verified. What no rare shingle joins is proven unlike. So the classes are those that all
pairs of all buckets give, and a shared passage or a family of copies costs rows in proportion to its members, not
their square. Rarity is a count by hash cell (CELLS at most); it steers cost only.

Classes are connected components by least-label contraction with pointer jumping, every round written to the shared
folder.

Edge cases: null texts and texts without words are one class each, by equal text only; texts of fewer than five words
are one shingle; repeated rows share a class; doc_ids may be null or repeat (the class id is the class's least doc_id,
null if it has none); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import join_texts, mix, runs, window_extreme, words
from .common import read, small_batches, whole, written

SHINGLE, PICK, BANDS, SIMILAR, BATCH_BYTES, BROADCAST_ROWS, CELLS, SLAB = 5, 3, 24, 0.8, 2_000_000, 1_000_000, 1 << 20, 200_000
TOP = np.uint64(2**64 - 1)


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all texts, and each text's first (n + 1 entries).

    hashes: word hashes; first: each text's first word. A text of one to four words has one shingle."""
    n = np.diff(first)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    start = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(n)), many)
    at = first[:-1][row] + np.arange(start[-1]) - start[:-1][row]
    padded = np.concatenate([hashes, np.zeros(SHINGLE, dtype=np.uint64)])
    left = first[1:][row] - at
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        w = np.where(left > k, padded[at + k], np.uint64(k + 1))
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
    # occurrence number among equal shingles of the text
    key = out ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]]) if len(key) else np.zeros(0, dtype=bool)
    if same.any():
        run = np.arange(len(key))
        head = np.maximum.accumulate(np.where(same, 0, run))
        nth = np.empty(len(key), dtype=np.uint64)
        nth[order] = (run - head).astype(np.uint64)
        out = np.where(nth > 0, mix(out + nth * np.uint64(0xD6E8FEB86659FD93)), out)
    return out, start


def samples(labelled: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each text its BANDS Order MinHash samples; texts without shingles have zeros."""
    n = np.diff(start)
    some = np.flatnonzero(n > 0)
    out = np.zeros((len(n), BANDS), dtype=np.uint64)
    if not len(some):
        return out
    at, size = start[:-1][some], n[some]
    for band in range(BANDS):
        odd = np.uint64(int(mix(np.array([band * 2 + 11], dtype=np.uint64))[0]) | 1)
        v = labelled * odd
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        where = np.full((PICK, len(some)), -1, dtype=np.int64)
        for k in range(PICK):
            least = np.minimum.reduceat(v, at)
            hit = np.flatnonzero(v == np.repeat(least, size))
            picked = hit[np.searchsorted(hit, at)]
            there = v[picked] != TOP
            where[k, there] = picked[there]
            v[picked] = TOP
        where.sort(axis=0)
        key = np.full(len(some), band + 1, dtype=np.uint64)
        for k in range(PICK):
            key = np.where(where[k] >= 0, mix(key * np.uint64(0x9E3779B97F4A7C15) + labelled[where[k]]), key)
        out[some, band] = key
    return out


SKETCH = "doc_id long, text_key string, node binary, n long, bands array<long>, words binary"


def sketch(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
    """Nodes, shingle counts, samples and packed 32-bit word hashes."""
    data, offsets = join_texts(texts)
    hashes, _, _, first = words(data, offsets)
    labelled, start = shingles(hashes, first)
    nodes, packed = [], []
    short = (hashes >> np.uint64(32)).astype("<u4")
    for i, t in enumerate(texts):
        own = slice(first[i], first[i + 1])
        nodes.append(md5(hashes[own].tobytes() if own.stop > own.start else t.encode("utf-8", "surrogatepass")).digest())
        packed.append(zlib.compress(short[own].tobytes(), 1))
    return nodes, np.diff(start), samples(labelled, start), packed


def sketched(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for i, j in runs(b.column(2), BATCH_BYTES):
                nodes, n, bands, packed = sketch(b.column(2).slice(i, j - i).to_pylist())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel().view(np.int64)))
                own = [c.slice(i, j - i) for c in b.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(nodes, pa.binary()), pa.array(n.astype(np.int64)), flat, pa.array(packed, pa.binary())], names=["doc_id", "text_key", "node", "n", "bands", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), whole("text").alias("text"))
    return rows.mapInArrow(run, SKETCH).withColumn("row", F.monotonically_increasing_id())


def text_key():
    return F.md5(whole("text").cast("binary")).alias("text_key")


def unpacked(blob: bytes) -> np.ndarray:
    """Labelled shingles of packed word hashes."""
    w = np.frombuffer(zlib.decompress(blob), dtype="<u4").astype(np.uint64)
    return shingles(w, np.array([0, len(w)]))[0]


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the longest chain of equal entries (each unique in its sequence) whose places differ by band
    at most."""
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    place = order[at]
    here = np.flatnonzero((b[place] == a) & (np.abs(place - np.arange(len(a))) <= band))
    place = place[here]
    if len(place) < 2 or (np.diff(place) > 0).all():
        return here, place
    tails, ends, before = [], [], []  # last place and entry of the best chain of each length; each entry's forerunner
    for i, p in enumerate(place.tolist()):
        k = bisect_left(tails, p)
        before.append(ends[k - 1] if k else -1)
        tails[k : k + 1], ends[k : k + 1] = [p], [i]
    picked, i = [], ends[-1]
    while i >= 0:
        picked.append(i)
        i = before[i]
    picked.reverse()
    return here[picked], place[picked]


def chain(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the chain that `aligned` finds."""
    return len(aligned(a, b, band)[0])


def under(places: np.ndarray) -> int:
    """Words under shingles that start at these places, in order."""
    return int(np.minimum(np.diff(places), SHINGLE).sum()) + SHINGLE if len(places) else 0


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two texts from their labelled shingles; a sole shingle counts as SHINGLE words."""
    if not len(a) or not len(b):
        return 0.0
    n, m = len(a) + SHINGLE - 1, len(b) + SHINGLE - 1
    if min(n, m) < SIMILAR * max(n, m):
        return 0.0
    least = SIMILAR * (n + m) / (1 + SIMILAR)  # aligned words that SIMILAR asks for
    one, two = aligned(a, b, int(max(n, m) - least) + 1)
    both = min(under(one), under(two))
    return both / (n + m - both)


def verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """pairs (a, b) of row numbers, with column similar. Only the word sequences that pairs name are moved."""

    def run(batches):
        for b in batches:
            last, kept = None, None
            similar = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                blob = x.as_py()
                if blob != last:
                    last, kept = blob, unpacked(blob)
                similar.append(similarity(kept, unpacked(y.as_py())) >= SIMILAR)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(similar, pa.bool_())], names=["a", "b", "similar"])

    pairs = written(pairs, "met")
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "named")
    small = named.count() <= BROADCAST_ROWS
    own = written(sequences.select("row", "words").join(F.broadcast(named) if small else named, "row", "left_semi"), "sequences")
    one, two = own.toDF("a", "words_a"), own.toDF("b", "words_b")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long, similar boolean")


def components(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component) for all nodes of the edges (a, b).

    In each round a node takes the label of its least neighbour if that is less than itself, and then that label's own;
    edges go on between labels, each once, and those within one label are gone. So the edges shrink from round to round."""
    ordered = lambda d, a, b: d.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col("a") < F.col("b")).distinct()
    rest, labels = written(ordered(edges, "a", "b"), "edges"), None
    while True:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
        near = written(near, "near")
        step = written(near.join(near.toDF("label", "to"), "label").select("node", F.col("to").alias("label")), "labels")
        if labels is None:
            labels = step
        else:
            labels = written(labels.join(step.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        rest = rest.join(step.toDF("a", "label_a"), "a").join(step.toDF("b", "label_b"), "b")
        rest = written(ordered(rest, "label_a", "label_b"), "edges")
        if not rest.limit(1).count():
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels with the components that further links join; only the links' labels are walked."""
    side = lambda c: labels.toDF(c, f"label_{c}")
    ends = links.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    edges = written(ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "links")
    if not edges.limit(1).count():
        return labels
    more = components(edges)
    known = labels.join(more.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(known.unionByName(more.join(labels.select("node"), "node", "left_anti")), "labels")


def led(buckets: DataFrame) -> DataFrame:
    """Rows of buckets of two texts or more, with column a: the bucket's leader, its first member by order."""
    heads = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("order", "row")).alias("first"))
    return buckets.join(heads.filter(F.col("size") > 1).select("key", F.col("first.row").alias("a")), "key")


def cells_for(n: int) -> int:
    """A power of two, about an eighth of n, from 2**10 to CELLS."""
    return min(CELLS, 1 << max(10, (n // 8).bit_length()))


def counted(texts: DataFrame, cells: int) -> np.ndarray:
    """Number of shingles of all texts by hash cell."""

    def run(batches):
        total = np.zeros(cells, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount((unpacked(x.as_py()) % np.uint64(cells)).astype(np.int64), minlength=cells)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    found = texts.select("words").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    out = np.zeros(cells, dtype=np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def spare(n, other):
    """Words of a text of n shingles that may be left out of the alignment with a text of `other` shingles, if they are
    similar; numbers or columns."""
    return (n + SHINGLE - 1) - (n + other + 2 * (SHINGLE - 1)) * (SIMILAR / (1 + SIMILAR)) + 1e-6


def rare(labelled: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles over those words, rarest first, of which one at least is aligned with any similar text; for each the
    rank of its rarest word; and what asking with them costs: the count of the last word that a text of the same length
    asks for. A word is as rare as the most frequent shingle over it."""
    n, edge = len(labelled) + SHINGLE - 1, np.zeros(SHINGLE - 1, dtype=np.int64)
    of = counts[(labelled % np.uint64(len(counts))).astype(np.int64)]
    most = window_extreme(np.concatenate([edge, of, edge]), SHINGLE, np.maximum)
    # by powers of two, so that words of one passage keep their order and share their shingles
    least = np.argsort(np.frexp(most.astype(np.float64))[1], kind="stable")[: int(n * (1 - SIMILAR) + 1e-6) + 1]
    rank = np.full(n, n, dtype=np.int64)
    rank[least] = np.arange(len(least))
    over = window_extreme(rank, SHINGLE, np.minimum)
    some = np.flatnonzero(over < n)
    return labelled[some], over[some], int(most[least[int(spare(len(labelled), len(labelled)))]])


def central(texts: DataFrame, counts) -> DataFrame:
    """row and order of texts: the more frequent a text's shingles are, the lower. In a family of copies the text that
    the others were made from, or the nearest to it, comes first."""

    def run(batches):
        for b in batches:
            own = [unpacked(x.as_py()) for x in b.column(1)]
            order = [-float(counts.value[(s % np.uint64(len(counts.value))).astype(np.int64)].mean()) for s in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(order, pa.float64())], names=["row", "order"])

    return texts.select("row", "words").mapInArrow(run, "row long, order double")


def spread(texts: DataFrame, counts, asks: bool) -> DataFrame:
    """shingle, label, row, n and cost of all shingles of texts, or only the rare ones, with their rank."""
    names = ["shingle", "label", "row", "n", "cost", *(["rank"] if asks else [])]

    def run(batches):
        for b in batches:
            own, meta, size = [], [], 0
            for x, *rest in zip(*(b.column(k) for k in ("words", "label", "row", "n")), strict=True):
                s = unpacked(x.as_py())
                few, rank, cost = rare(s, counts.value)
                own.append((few, rank) if asks else (s,))
                meta.append([*(v.as_py() for v in rest), cost])
                size += len(own[-1][0])
                if size >= SLAB:
                    yield slab(own, meta)
                    own, meta, size = [], [], 0
            if own:
                yield slab(own, meta)

    def slab(own, meta):
        each = [len(s[0]) for s in own]
        own = [np.concatenate(c).view(np.int64) for c in zip(*own, strict=True)]
        meta = [np.repeat(np.array(c, dtype=np.int64), each) for c in zip(*meta, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (own[0], *meta, *own[1:])], names=names)

    return texts.select("words", "label", "row", "n").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def labelled_by(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with column label: their component's, or their own number."""
    return rows.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))


def left_open(buckets: DataFrame, labels: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, row and label of buckets with more than one class, and row, n, label and words of their members."""
    now = labelled_by(buckets.select("key", "row"), labels)
    mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") < F.col("high"))
    now = written(now.join(mixed.select("key"), "key"), "mixed")
    members = written(now.select("row", "label").distinct(), "members")
    small = members.count() <= BROADCAST_ROWS
    return now, written(sequences.select("row", "n", "words").join(F.broadcast(members) if small else members, "row"), "open")


def unsettled(texts: DataFrame, counts) -> DataFrame:
    """Pairs (a, b) of open texts of different classes that may be similar: all others are proven unlike. Of two texts
    the one with the lower cost asks, so a text that lacks much of its family asks the few that share the rest."""
    asked = spread(texts, counts, True).toDF("shingle", "label_a", "a", "n_a", "cost_a", "rank")
    asked = asked.withColumn("order_a", F.struct("cost_a", "a"))
    ends = [F.max(F.struct("cost", "row")).alias("last"), F.min("n").alias("low"), F.max("n").alias("high")]
    classes_ = spread(texts, counts, False).groupBy("shingle", "label").agg(*ends)
    within = lambda low, high: (low <= (F.col("n_a") + SHINGLE - 1) / SIMILAR) & (high >= (F.col("n_a") + SHINGLE - 1) * SIMILAR - SHINGLE)
    hits = asked.join(classes_, "shingle").filter((F.col("label") != F.col("label_a")) & (F.col("order_a") < F.col("last")))
    hits = hits.filter(within(F.col("low"), F.col("high")) & (F.col("rank") <= spare(F.col("n_a"), F.col("low"))))
    hits = written(hits.select("shingle", "label", "a", "n_a", "order_a", "rank"), "hits")
    wanted = written(hits.select("shingle", "label").distinct(), "wanted")
    small = wanted.count() <= BROADCAST_ROWS
    there = spread(texts, counts, False).join(F.broadcast(wanted) if small else wanted, ["shingle", "label"], "left_semi").withColumnRenamed("row", "b")
    pairs = hits.join(there, ["shingle", "label"]).filter((F.col("order_a") < F.struct("cost", "b")) & within(F.col("n"), F.col("n")) & (F.col("rank") <= spare(F.col("n_a"), F.col("n"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id, text_key and node of each row; node, class_id, n_class, n_links, keep_id and keep_key
    (doc_id and text_key of the row to keep, the least of the class, null ids last)."""
    small_batches(docs.sparkSession)
    sketches = written(sketched(docs), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    nodes = written(sketches.groupBy("node").agg(F.min("row").alias("row"), F.first("bands").alias("bands"), F.first("n").alias("n"), least, F.count(F.lit(1)).alias("n_rows")), "nodes")
    buckets = nodes.filter(F.col("n") > 0).select("row", F.xxhash64("node").alias("order"), F.explode("bands").alias("key"))
    shared = written(led(buckets), "shared")
    pairs = shared.filter(F.col("a") != F.col("row")).select("a", F.col("row").alias("b")).distinct()
    links = written(verified(pairs, sketches), "pairs").filter("similar")
    labels = components(links)
    mixed, texts = left_open(shared, labels, sketches)
    size = texts.agg(F.sum("n")).first()[0]
    if size:
        counts = docs.sparkSession.sparkContext.broadcast(counted(texts, cells_for(size)))
        again = led(mixed.join(central(texts, counts), "row")).join(texts.select(F.col("row").alias("a"), F.col("label").alias("label_a")), "a")
        again = again.filter(F.col("label") != F.col("label_a")).select("a", F.col("row").alias("b")).distinct()
        again = written(verified(again, texts), "pairs").filter("similar")
        labels = extended(labels, again)
        texts = left_open(mixed, labels, texts)[1]
        more = written(verified(unsettled(texts, counts), texts), "pairs").filter("similar")
        labels = extended(labels, more)
        links = links.unionByName(again).unionByName(more)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = labels.join(degree, "node").withColumnRenamed("node", "row")
    of = nodes.select("node", "row", "least", "n_rows").join(known, "row", "left")
    of = written(of.select("node", "least", "n_rows", F.coalesce("label", "row").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "labelled")
    whole_ = of.groupBy("label").agg(F.min("least").alias("least"), F.sum("n_rows").alias("n_class"))
    judged = of.select("node", "label", "n_links").join(whole_, "label").select("node", F.col("least.doc_id").alias("class_id"), "n_class", "n_links", F.col("least.text_key").alias("keep_key"))
    return sketches.select("doc_id", "text_key", "node"), written(judged, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (verified links of the row's text to other texts), n_class."""
    rows, judged = classes(docs)
    return rows.join(judged, "node").select("doc_id", "class_id", "n_links", "n_class")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: its least doc_id."""
    kept = classes(docs)[1].select("class_id", "keep_key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("id"), text_key())
    out = rows.join(kept, rows["id"].eqNullSafe(kept["class_id"]) & (rows["text_key"] == kept["keep_key"]))
    return out.dropDuplicates(["id", "text_key"]).select("whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


__all__ = ["near_duplicates", "query"]
