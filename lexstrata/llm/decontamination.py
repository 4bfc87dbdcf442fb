"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are runs of letters and digits, lower-cased. A fixed mask ignores some of the words under it and hashes the
rest, so a replaced word leaves some seeds whole. Seeds of the test items are joined with those of the documents
(broadcast if they are at most BROADCAST_SEEDS rows, else by a shuffle join). Around each hit the document and the
item are laid side by side: some WINDOW words of the item (all, if it has fewer) must agree with the document's in
at least SHARE of their places.

Masks find all windows of 12 or 13 words that agree so far. A shorter item is one window; with e places that may
differ it is cut into e + 1 blocks, one of which any match keeps whole, and the blocks are its seeds: runs of one to
five words, of which documents give only the lengths that some item needs. Items of one to four words so match as
whole word sequences.

Edge cases: null texts count as empty; items without words match nothing; equal items match separately; repeated
documents match alike; empty tables give an empty result; further columns are kept by `clean` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, whole, written

#: 1: the word counts; 0: any word may stand there.
MASKS = ("11111", "1101101", "1110011", "1011011")
WINDOW, SHARE, BROADCAST_SEEDS = 13, 0.8, 1_000_000
#: Items of fewer words are cut into blocks.
MASKED = 12


def blocks(n: int) -> list[tuple[int, int]]:
    """Start and length of the blocks of an item of n words: one more than places that may differ."""
    parts = n - -(-n * 8 // 10) + 1  # SHARE of n, rounded up, must agree
    return [(i * n // parts, (i + 1) * n // parts - i * n // parts) for i in range(parts)]


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def seed(words: Column, at: Column, mask: str) -> Column:
    """Hash of the words under a mask; null where the mask passes the end."""
    picked = [F.get(words, at + i) for i, b in enumerate(mask) if b == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *picked))


def seeds(rows: DataFrame, words: str, masks: list[str]) -> DataFrame:
    """A row for each place and mask: columns at and seed are added. The outer form spares a second look at the words."""
    placed = rows.select("*", F.posexplode_outer(words).alias("at", "__word")).drop("__word")
    each = F.explode(F.array(*[seed(F.col(words), F.col("at"), m) for m in masks])).alias("seed")
    return placed.select("*", each).filter(F.col("seed").isNotNull())


def item_seeds(items: DataFrame, sizes: set[int]) -> tuple[DataFrame, list[str]]:
    """seed, item, item_at and item_size of all seeds of items, and the masks that find them in documents."""
    n = F.size("item_words")
    named = ["seed", "item", F.col("at").alias("item_at"), n.alias("item_size")]
    out, masks = seeds(items.filter(n >= MASKED), "item_words", list(MASKS)).select(*named), list(MASKS) if max(sizes, default=0) >= MASKED else []
    for size in sorted(s for s in sizes if 0 < s < MASKED):
        own = [(at, "1" * many) for at, many in blocks(size)]
        each = F.explode(F.array(*[F.struct(F.lit(at).alias("at"), seed(F.col("item_words"), F.lit(at), m).alias("seed")) for at, m in own])).alias("s")
        out = out.unionByName(items.filter(n == size).select("item", "item_words", each).select("item", "item_words", "s.at", "s.seed").select(*named))
        masks += [m for _, m in own]
    return out, list(dict.fromkeys(masks)) or list(MASKS)


def overlap(words: Column, item: Column) -> tuple[Column, Column]:
    """Most agreeing places of any window of the item, and the window's length; words: the document's, side by side with
    the item's, null where it has none."""
    n = F.size(item)
    length = F.least(n, F.lit(WINDOW))
    same = F.zip_with(item, words, lambda v, w: F.when(w == v, 1).otherwise(0))
    sums = F.transform(F.sequence(F.lit(1), n - length + 1), lambda s: F.aggregate(F.slice(same, s, length), F.lit(0), lambda a, x: a + x))
    return F.array_max(sums), length


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that agree: doc_id, text_key (md5 of the text), item_id, n_same, n_window.

    Hits carry the document's words beside the item only; they are made distinct before they are verified, so a place
    that many seeds hit is looked at once."""
    items = benchmark.select("item_id", word_hashes(whole("text")).alias("item_words"))
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "item_words")
    items = written(items, "items")
    sizes = {r[0] for r in items.select(F.least(F.size("item_words"), F.lit(MASKED))).distinct().collect()}  # MASKED + 1 at most
    found, masks = item_seeds(items, sizes)
    found = written(found, "seeds")
    small = found.count() <= BROADCAST_SEEDS
    texts = docs.select("doc_id", F.md5(whole("text").cast("binary")).alias("text_key"), word_hashes(whole("text")).alias("words"))
    if small:
        hits = seeds(texts, "words", masks).join(F.broadcast(found), "seed")
    else:  # places and seeds alone are shuffled; the words of texts with a hit follow
        spots = seeds(texts, "words", masks).select("doc_id", "text_key", "at", "seed").join(found, "seed").drop("seed")
        spots = written(spots.distinct(), "spots").withColumnsRenamed({"doc_id": "spot_id", "text_key": "spot_key"})
        hits = spots.join(texts, (F.col("spot_key") == F.col("text_key")) & F.col("spot_id").eqNullSafe(F.col("doc_id")))
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(shift, F.lit(0))
    beside = F.slice("words", first + 1, F.least(F.col("item_size"), F.size("words") - first))
    places = hits.select("doc_id", "text_key", "item", F.least(shift, F.lit(0)).alias("before"), beside.alias("beside")).distinct()
    both = places.join(F.broadcast(items) if small else items, "item")
    words = F.concat(F.array_repeat(F.lit(None).cast("long"), -F.col("before")), F.col("beside"))
    padded = F.slice(F.concat(words, F.array_repeat(F.lit(None).cast("long"), F.size("item_words"))), F.lit(1), F.size("item_words"))
    same, length = overlap(padded, F.col("item_words"))
    shown = both.select("doc_id", "text_key", "item_id", same.alias("n_same"), length.alias("n_window"))
    enough = shown.filter(F.col("n_same") >= F.ceil(F.col("n_window") * F.lit(SHARE)))
    return enough.groupBy("doc_id", "text_key", "item_id").agg(F.max("n_same").alias("n_same"), F.max("n_window").alias("n_window"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those whose text agrees with a test item."""
    keys = written(contaminated(docs, benchmark).select("text_key").distinct(), "contaminated")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_SEEDS else keys
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.md5(whole("text").cast("binary")).alias("text_key"))
    return rows.join(keys, "text_key", "left_anti").select("whole.*")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")
