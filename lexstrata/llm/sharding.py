"""Sharding by fixed virtual slots.

Records hash by their text into a fixed number of virtual slots, so equal texts share a slot. The bytes of each slot
are aggregated, and a versioned map, kept as a table, assigns slots to shards. Version 1 deals slots out in their order,
before any size is known; once the sizes are, `rebalance` edits it into version 2: slots leave the heaviest shard for
the lightest until all are within TOLERANCE of the mean or no move helps, and all other slots stay where they are.

An entry of the map is a slot. Only where a slot holds more than 1/FINE of a shard it is entered as SUB parts by a
second hash of the text, so that equal texts still stay together, and only a text whose copies exceed a whole shard is
entered as PIECES parts by row. The map so has at most SLOTS + FINE x shards x SUB + shards x PIECES entries, whatever
the input.

Law: `bytes` (sizes near equal). Places in a shard come from counts per (shard, range) and ranks within a range of
about RANGE rows, so no window spans a shard, a slot or a text.

Edge cases: null text counts as empty (size 8, crc32 0); doc_ids may be null or repeat; repeated rows are separate
records; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_dir, whole, written

SLOTS, SUB, PIECES, FINE, TOLERANCE, RANGE = 4096, 64, 1024, 16, 0.001, 200_000
MAP_SCHEMA = "version int, slot int, sub int, piece int, shard int, bytes long, rows long"
#: slot, sub (-1: the whole slot), piece (-1: the whole sub), shard, bytes, rows
Entry = tuple[int, int, int, int, int, int]


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The numbers of each row that sharding needs. The piece is a row's own, so the result must be written once."""
    text = whole("text")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("virtual_slot"),
        F.pmod(F.xxhash64(text, F.lit(11)), F.lit(SUB)).cast("int").alias("sub"),
        (F.rand(7) * PIECES).cast("int").alias("piece"),
    )


def dealt(slots: int, shards: int) -> dict[int, int]:
    """Shards of slots before sizes are known."""
    return {s: s * shards // slots for s in range(slots)}


def rebalance(entries: list[Entry], shards: int, tolerance: float = TOLERANCE) -> list[Entry]:
    """Edits a slot map for new loads or more shards: slots leave the heaviest shard for the lightest until each is
    within tolerance of the mean or no move helps. All other slots stay where they are."""
    held: dict[int, list[Entry]] = {s: [] for s in range(shards)}
    for e in entries:
        held.setdefault(e[3], []).append(e)
    load = {s: sum(e[4] for e in v) for s, v in held.items()}
    lightest = lambda: min((s for s in load if s < shards), key=lambda s: (load[s], s))
    for gone in [s for s in held if s >= shards]:
        for e in sorted(held.pop(gone), key=lambda e: (-e[4], e)):
            to = lightest()
            held[to].append(e)
            load[to] += e[4]
        load.pop(gone)
    mean = sum(load.values()) / shards
    while True:
        high, low = max(load, key=lambda s: (load[s], -s)), lightest()
        gap = load[high] - load[low]
        room = min(0.95 * gap, load[high] - mean)  # no shard gives more than it has too much
        movable = [e for e in held[high] if 0 < e[4] <= room]
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance) or not movable:
            break
        # the slot that leaves both as near to each other as can be
        x = min(movable, key=lambda e: (abs(gap - 2 * e[4]), e))
        held[high].remove(x)
        held[low].append(x)
        load[high] -= x[4]
        load[low] += x[4]
    return [(*e[:3], s, *e[4:]) for s, v in held.items() for e in v]


def loads(slotted: DataFrame, shards: int) -> list[tuple[int, int, int, int, int]]:
    """slot, sub, piece, bytes and rows of the map's entries: whole slots, parts of heavy ones by text, and parts by row
    of texts that exceed a shard."""
    sums = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")]
    fine = written(slotted.groupBy("virtual_slot", "sub").agg(*sums), "slot-loads")  # SLOTS x SUB rows
    coarse = fine.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    mean = sum(r["bytes"] for r in coarse) / shards
    heavy = sorted(r["virtual_slot"] for r in coarse if r["bytes"] > mean / FINE)
    out = [(r["virtual_slot"], -1, -1, r["bytes"], r["rows"]) for r in coarse if r["bytes"] <= mean / FINE]
    if heavy:
        parts = [tuple(r) for r in fine.filter(F.col("virtual_slot").isin(heavy)).select("virtual_slot", "sub", "bytes", "rows").collect()]
        over = [(s, b) for s, b, size, _ in parts if size > mean]
        out += [(s, b, -1, size, rows) for s, b, size, rows in parts if size <= mean]
        if over:
            whole_ = F.struct("virtual_slot", "sub").isin(*[F.struct(F.lit(s), F.lit(b)) for s, b in over])
            out += [tuple(r) for r in slotted.filter(whole_).groupBy("virtual_slot", "sub", "piece").agg(*sums).collect()]
    return out


def placed(rows: DataFrame, shards: int) -> DataFrame:
    """rows with column slot: their place in their shard, from 0. Ranges are by hash, about RANGE rows each."""
    n = rows.count()
    ranges = max(1, -(-n // (RANGE * shards)))
    ranged = rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "text_crc32", "piece"), F.lit(ranges)).cast("int"))
    counts = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size"))
    return ranged.withColumn("rank", rank).join(counts.select("shard", "range", before.alias("before")), ["shard", "range"]).withColumn("slot", (F.col("before") + F.col("rank") - 1).cast(T.LongType()))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    spark = docs.sparkSession
    slotted = written(with_slots(docs), "slotted")
    first = dealt(SLOTS, shards)
    version_1 = [(s, b, p, first[s], size, rows) for s, b, p, size, rows in loads(slotted, shards)]
    version_2 = rebalance(version_1, shards)
    path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    spark.createDataFrame([(v, *e) for v, m in ((1, version_1), (2, version_2)) for e in sorted(m)], MAP_SCHEMA).coalesce(1).write.parquet(path)
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    at = lambda v, name: stored.filter(F.col("version") == v).select(F.col("slot").alias("virtual_slot"), F.col("sub").alias("in_sub"), F.col("piece").alias("in_piece"), F.col("shard").alias(name))
    key = ["virtual_slot", "in_sub", "in_piece"]
    both = at(2, "shard").join(at(1, "was_shard"), key)
    parted = sorted({e[0] for e in version_2 if e[1] >= 0})
    pieced = sorted({e[:2] for e in version_2 if e[2] >= 0})
    in_sub = F.when(F.col("virtual_slot").isin(parted), F.col("sub")).otherwise(-1) if parted else F.lit(-1)
    in_piece = F.when(F.struct("virtual_slot", "sub").isin(*[F.struct(F.lit(s), F.lit(b)) for s, b in pieced]), F.col("piece")).otherwise(-1) if pieced else F.lit(-1)
    assigned = slotted.withColumns({"in_sub": in_sub, "in_piece": in_piece}).join(F.broadcast(both), key)  # the map's size is bounded
    return placed(assigned, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(2).alias("map_version"),
        "was_shard",
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return shard_documents(read(spark, sf_dir, "documents"))
