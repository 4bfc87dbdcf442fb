"""Exact top-k inner products by vector-approximation files.

Components become integers floor(64 * x). Vectors are written as files of at most FILE vectors of one length, a row
each: one byte per component, the cell of 2**BITS between the file's least and greatest value of that component, and the
exact vectors beside them. For a query the cells alone give an upper bound of every inner product: the product of the
query's steps with the cells, plus what the cells' widths can add. Exact vectors are then read in the order of these
bounds until the next bound is below the kth result, which is then certain (ties included).

Queries are taken in blocks of BLOCK rows, which bounds what is broadcast; each block meets every file in one pass over
them, and nothing of the vectors is shuffled. A block brings for each query the kth score among at most SAMPLE vectors,
so a file reads exact vectors only for bounds that reach it, and files as a whole are passed over by the bound of their
least and greatest values. The k best of all files' results are the result.

Bounds are computed in single precision and raised by more than its rounding error; inner products are exact 64-bit
integers, or Python's integers for a file or a query whose values could exceed them. Scores beyond 64 bits are an error.

Edge cases: vectors that are null or hold a null or non-finite component take no part; vectors meet only vectors of
their own length, and empty ones none; repeated vec_ids are rows of their own; ties go to the smaller vec_id, null
ids first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, written

FILE, BLOCK, SAMPLE, BITS, STEP, TOP = 8192, 16384, 4096, 4, 64, 20
FILES = "dims int, rows binary, ids binary, known binary, cells binary, low binary, step binary, exact binary"
FOUND = "query_row long, query_id long, vec_id long, score long"
LEAST = np.iinfo(np.int64).min


def quantised(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id and x, an array of long."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 64))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def products(exact: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    most = float(np.abs(exact.astype(np.float64)).max(initial=0)) * float(np.abs(query.astype(np.float64)).sum())
    if most < 2**62:
        return exact @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in exact], dtype=np.int64)


class ApproximationFile:
    """Cells of a set of vectors, and the vectors themselves."""

    def __init__(self, exact: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray):
        self.exact, self.low, self.step, self.cells = exact, low, step, cells
        self.points = cells.astype(np.float32)
        self.reach = float(np.abs(np.stack([low, low + step * (1 << BITS)]).astype(np.float64)).max(initial=0))

    @classmethod
    def of(cls, exact: np.ndarray) -> ApproximationFile:
        low = exact.min(axis=0)
        step = (exact.max(axis=0) - low) // (1 << BITS) + 1
        return cls(exact, low, step, ((exact - low) // step).astype(np.uint8))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of all inner products, from the cells alone."""
        q = queries.astype(np.float64)
        fixed = q @ self.low.astype(np.float64) + np.maximum(q, 0) @ (self.step - 1).astype(np.float64)
        spare = np.abs(q).sum(axis=1) * self.reach * len(self.low) * 2.0**-20 + 1
        return (q * self.step).astype(np.float32) @ self.points.T + (fixed + spare)[:, None]

    def most(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds over the whole file, from its least and greatest values."""
        q = queries.astype(np.float64)
        high = (self.low + self.step * (1 << BITS) - 1).astype(np.float64)
        return np.maximum(q, 0) @ high + np.minimum(q, 0) @ self.low.astype(np.float64) + np.abs(q).sum(axis=1) * self.reach * 2.0**-40 + 1

    def search(self, query: np.ndarray, bound: np.ndarray, k: int, ids: np.ndarray, own: int, kth: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best for one query, ties to smaller ids; own: a place left out, or -1; kth: a score
        that the result reaches anyway."""
        near = np.flatnonzero(bound >= kth) if kth is not None else np.arange(len(bound))
        order = near[np.argsort(-bound[near], kind="stable")]
        places, values = order[:0], np.zeros(0, dtype=np.int64)
        for at in range(0, len(order), STEP):
            if len(values) == k and bound[order[at]] < values[-1]:
                break
            take = order[at : at + STEP]
            take = take[take != own]
            places, values = np.concatenate([places, take]), np.concatenate([values, products(self.exact[take], query)])
            best = np.lexsort((ids[places], -values))[:k]
            places, values = places[best], values[best]
        return places, values


def files(vectors: DataFrame) -> DataFrame:
    """Rows of `quantised` as approximation files."""

    def run(batches):
        held: dict[int, list[tuple]] = {}

        def flush(dims: int):
            rows, ids, x = zip(*held.pop(dims), strict=True)
            f = ApproximationFile.of(np.array(x, dtype=np.int64))
            known = np.array([i is not None for i in ids])
            cells = [dims, np.array(rows, dtype=np.int64).tobytes(), np.array([LEAST if i is None else i for i in ids], dtype=np.int64).tobytes(), known.tobytes(), f.cells.tobytes(), f.low.tobytes(), f.step.tobytes(), f.exact.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in [pa.scalar(dims, pa.int32()), *cells[1:]]], names=[c.split()[0] for c in FILES.split(", ")])

        for b in batches:
            for row, i, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(len(x), []).append((row, i, x))
                if len(held[len(x)]) >= FILE:
                    yield flush(len(x))
        for dims in list(held):
            yield flush(dims)

    return vectors.select("row", "vec_id", "x").mapInArrow(run, FILES)


@dataclass
class Block:
    """Queries of one length: their row numbers, ids (None if null) and vectors, and a score that each one's result reaches."""

    rows: np.ndarray
    ids: list
    x: np.ndarray
    kth: list


def blocks_of(rows: list, sample: list, k: int) -> dict[int, Block]:
    """Queries by their length, with the kth score among the sample's vectors other than the query's own row."""
    out = {}
    for dims in {len(r["x"]) for r in rows}:
        own = [r for r in rows if len(r["x"]) == dims]
        x = np.array([r["x"] for r in own], dtype=np.int64)
        like = [s for s in sample if len(s["x"]) == dims]
        kth: list = [None] * len(own)
        if len(like) > k:
            exact, names = np.array([s["x"] for s in like], dtype=np.int64), np.array([s["row"] for s in like])
            small = float(np.abs(exact.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).sum(axis=1).max()) < 2**53
            points = exact.astype(np.float64).T  # whole numbers below 2**53 stay exact
            for a in range(0, len(own), 256):
                scores = x[a : a + 256].astype(np.float64) @ points if small else None
                for i in range(a, min(a + 256, len(own))):
                    others = (scores[i - a] if small else products(exact, x[i]))[names != own[i]["row"]]
                    kth[i] = int(np.partition(others, len(others) - k)[len(others) - k])
        out[dims] = Block(np.array([r["row"] for r in own], dtype=np.int64), [r["vec_id"] for r in own], x, kth)
    return out


def searched(stored: DataFrame, blocks: dict[int, Block], k: int) -> DataFrame:
    """The k best of each file for each query of the blocks."""
    shipped = stored.sparkSession.sparkContext.broadcast(blocks)  # BLOCK queries at most
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                block = shipped.value.get(r["dims"])
                if block is None:
                    continue
                shape = (-1, r["dims"])
                f = ApproximationFile(np.frombuffer(r["exact"], np.int64).reshape(shape), np.frombuffer(r["low"], np.int64), np.frombuffer(r["step"], np.int64), np.frombuffer(r["cells"], np.uint8).reshape(shape))
                ids, rows, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64), np.frombuffer(r["known"], bool)
                order = np.argsort(rows)
                place = np.minimum(np.searchsorted(rows, block.rows, sorter=order), len(rows) - 1)
                own = np.where(rows[order[place]] == block.rows, order[place], -1)
                most = f.most(block.x)
                reach = [i for i in range(len(block.rows)) if block.kth[i] is None or most[i] >= block.kth[i]]
                found: list[list] = [[], [], [], []]
                for a in range(0, len(reach), 256):
                    part = reach[a : a + 256]
                    bounds = f.bounds(block.x[part])
                    for i, bound in zip(part, bounds, strict=True):
                        at, score = f.search(block.x[i], bound, k, ids, int(own[i]), block.kth[i])
                        found[0] += [int(block.rows[i])] * len(at)
                        found[1] += [block.ids[i]] * len(at)
                        found[2] += [int(ids[p]) if known[p] else None for p in at]
                        found[3] += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)

    return stored.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """queries and vectors: rows of `quantised`; a query leaves out the vector with its own row number."""
    stored = written(files(vectors), "files")
    sample = vectors.orderBy(F.xxhash64("row")).limit(SAMPLE).collect()
    many = max(1, -(-queries.count() // BLOCK))
    found = None
    for n in range(many):  # blocks are dealt by hash; about BLOCK rows each
        rows = (queries.filter(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(many)) == n) if many > 1 else queries).collect()
        best = searched(stored, blocks_of(rows, sample, k), k)
        best = written(best, "best") if many > 1 else best
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = written(quantised(read(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
