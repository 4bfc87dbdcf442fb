"""Toxic spans by a linear-chain conditional random field; its marginals give document scores and offending offsets.

Words are runs of letters and digits (and any byte over 127), A-Z folded; a word's features are the word itself and
its first 3 to 6 bytes and last 4. Token labels come from the labelled documents: a feature that toxic documents
of the training sample have far more often than clean ones (odds and likelihood ratio) marks its tokens as toxic there. The field (two states, emission
weight per feature, transition weights) is fitted by AdaGrad on the log-likelihood; forward-backward marginals over
the whole text follow as ratios, vectorised over documents of like length. The score is a logistic function of the
two highest marginals and of the log of their sum over 1/2.

The sample is bounded: the SAMPLE documents of each label that come first in the order of a hash of their text, whole
texts of any length, near copies (equal minimum of three-word hashes) once. Only while the field is fitted long chains
are cut into runs of CHAIN tokens, all of which count. Scores read nothing but the text.

Edge cases: a null or empty text gets the score of a text without marginals; rows with a null doc_id are not held
out; a doc_id with labels that disagree is not learnt from; with no labelled rows of both kinds all scores are 0;
repeated rows are scored alike; an empty table gives an empty result; further columns are kept by `clean` whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._bytes import join_texts, mix, prefix_hash, runs, span_hash
from .common import read, small_batches, trim, whole

SAMPLE, CHAIN, ROUNDS, BATCH_BYTES, FIT_BYTES, THRESHOLD = 1000, 512, 60, 1_000_000, 500_000, 0.7
LEAST_ODDS, LEAST_RATIO, BROADCAST_ROWS, SALTS = 12.0, 30.0, 1_000_000, 64
FEATURES = (("word", None), ("first", 3), ("first", 4), ("first", 5), ("first", 6), ("last", 4))

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (tokens x features), byte starts and ends of the tokens, first token of each text, text offsets."""
    data, offsets = join_texts(texts)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    prefix = prefix_hash(_FOLD[data])
    out = np.empty((len(starts), len(FEATURES)), dtype=np.uint64)
    for k, (kind, n) in enumerate(FEATURES):
        a = starts if kind != "last" else np.maximum(starts, ends - n)
        b = ends if kind != "first" else np.minimum(ends, starts + n)
        out[:, k] = span_hash(prefix, a, b) + np.uint64(k)
    return out, starts, ends, np.searchsorted(starts, offsets), offsets


@dataclass
class Model:
    """keys: sorted feature hashes; weights: theirs; change: log weights of the four transitions; document: logistic weights."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    change: np.ndarray
    document: np.ndarray | None

    def __post_init__(self):
        self.slots = np.zeros(1 << 20, dtype=np.int32)
        self.slots[(self.keys & np.uint64(len(self.slots) - 1)).astype(np.int64)] = 1

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each feature, -1 where the model lacks it."""
        out = np.full(hashes.shape, -1, dtype=np.int32)
        for k in range(hashes.shape[1] if len(self.keys) else 0):  # one feature at a time: temporaries stay small
            maybe = np.flatnonzero(self.slots[(hashes[:, k] & np.uint64(len(self.slots) - 1)).astype(np.int64)])
            h = hashes[maybe, k]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out[maybe, k] = np.where(self.keys[at] == h, at, -1)
        return out

    def emissions(self, columns: np.ndarray) -> np.ndarray:
        own = np.append(self.weights, 0.0)
        return sum((own[columns[:, k]] for k in range(columns.shape[1])), np.full(len(columns), self.bias))


def padded(first: np.ndarray, cells: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts of like length: their numbers, and token index and presence by (place, text)."""
    n = np.diff(first)
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    while len(order):
        width = max(1, int(cells // n[order[-1]]))
        group, order = order[-width:], order[:-width]
        place = np.arange(n[group].max())[:, None]
        there = place < n[group][None, :]
        yield group, np.where(there, first[group][None, :] + place, 0), there


def marginals(emission: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state at each token, and expected counts of the four transitions."""
    t = np.exp(change)
    out = np.zeros(len(emission))
    pairs = np.zeros((2, 2))
    for _, index, there in padded(first):
        e = np.where(there, np.exp(np.clip(emission[index], -30, 30)), 1.0)
        n = len(e)
        a = np.empty_like(e)
        r = e[0]
        a[0] = r
        for i in range(1, n):
            r = np.clip(e[i] * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r), 1e-250, 1e250)
            a[i] = r
        b = np.ones_like(e)
        r = b[-1]
        for i in range(n - 2, -1, -1):
            x = e[i + 1] * r
            r = np.where(there[i + 1], (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), 1.0)
            b[i] = r
        p = a * b / (1 + a * b)
        out[index[there]] = p[there]
        x = e[1:] * b[1:]
        joint = np.stack([np.full_like(x, t[0, 0]), t[0, 1] * x, t[1, 0] * a[:-1], t[1, 1] * a[:-1] * x])
        joint /= joint.sum(axis=0)
        pairs += (joint * there[1:]).sum(axis=(1, 2)).reshape(2, 2)
    return out, pairs


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: highest and second highest marginal, log of one more than their sum over 1/2."""
    out = np.zeros((len(first) - 1, 3))
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        at = first[some]
        n = np.diff(first)[some]
        top = np.maximum.reduceat(p, at)
        where = np.flatnonzero(p == np.repeat(top, n))
        firsts = where[np.searchsorted(where, at)]
        rest = p.copy()
        rest[firsts] = 0
        out[some, 0], out[some, 1] = top, np.maximum.reduceat(rest, at)
        out[some, 2] = np.log1p(np.add.reduceat(np.where(p > 0.5, p, 0), at))
    return out


def seen_in(hashes: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of one feature, and how many toxic and how many clean texts have each."""
    keys, inverse = np.unique(hashes, return_inverse=True)
    pairs = np.unique(inverse * np.int64(len(toxic)) + row)  # each feature once a text
    at, of = pairs // len(toxic), toxic[pairs % len(toxic)]
    return keys, np.bincount(at, of, len(keys)), np.bincount(at, 1 - of, len(keys))


def chains(first: np.ndarray) -> np.ndarray:
    """First tokens of the runs of CHAIN tokens at most that texts fall into, and the end."""
    starts = [np.arange(a, b, CHAIN) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate([*starts, first[-1:]]).astype(first.dtype)


def slices(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` characters each, one text at least."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size or i == len(texts) - 1:
            yield begin, i + 1
            begin, held = i + 1, 0


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """A model of labelled texts."""
    parts, n = [], []
    for i, j in slices(texts, FIT_BYTES):
        h, _, _, own, _ = tokens(texts[i:j])
        parts.append(h)
        n.append(np.diff(own))
    first = np.concatenate([[0], np.cumsum(np.concatenate(n))])
    feature = lambda k: np.concatenate([p[:, k] for p in parts])  # noqa: E731  one feature at a time: temporaries stay small
    # near copies count once: the least hash of three words in a row
    word = feature(0)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    least = np.zeros(len(texts), dtype=np.uint64)
    for i in range(len(texts)):
        w = word[first[i] : first[i + 1]]
        s = mix(w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:]) if len(w) > 2 else w
        least[i] = s.min() if len(s) else i
    once = np.unique(np.stack([least, toxic.astype(np.uint64)], 1), axis=0, return_index=True)[1]
    keep = np.isin(row, once)
    found = [seen_in(feature(k)[keep], row[keep], toxic) for k in range(len(FEATURES))]  # features differ in their keys
    keys = np.concatenate([f[0] for f in found])
    by = np.argsort(keys, kind="stable")
    keys, in_toxic, in_clean = keys[by], *(np.concatenate([f[i] for f in found])[by] for i in (1, 2))
    n_toxic, n_clean = max(1, toxic[once].sum()), max(1, (1 - toxic[once]).sum())
    odds = (in_toxic / n_toxic) / ((in_clean + 0.5) / n_clean)
    share = (in_toxic + in_clean) / (n_toxic + n_clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.nan_to_num(in_toxic * np.log(in_toxic / (share * n_toxic))) + np.nan_to_num(in_clean * np.log(in_clean / (share * n_clean))))
    # so many features are tested that chance alone would mark some below this
    marked = (odds >= LEAST_ODDS) & (ratio >= LEAST_RATIO)
    used = (in_toxic + in_clean >= 3) | marked
    model = Model(keys[used], np.zeros(int(used.sum())), -3.0, np.log(np.array([[0.95, 0.05], [0.7, 0.3]])), None)
    columns = np.empty((len(row), len(FEATURES)), dtype=np.int32)
    for k in range(len(FEATURES)):
        columns[:, k] = model.columns(feature(k)[:, None])[:, 0]
    parts.clear()
    mark = np.append(marked[used], False)
    y = np.zeros(len(columns))
    for k in range(len(FEATURES)):
        y += mark[columns[:, k]]
    y = ((y > 0) & (toxic[row] == 1)).astype(float)
    cut = chains(first)
    follow = np.ones(len(y), dtype=bool)
    follow[cut[:-1]] = False
    was, now = y[np.flatnonzero(follow) - 1].astype(int), y[follow].astype(int)
    truth = np.bincount(was * 2 + now, minlength=4).reshape(2, 2).astype(float)
    step_w, step_b, step_t = np.full(len(model.keys), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    scale = max(1.0, y.sum())
    for _ in range(ROUNDS if y.any() else 0):
        p, pairs = marginals(model.emissions(columns), model.change, cut)
        miss = y - p
        g = sum(np.bincount(columns[:, k] + 1, miss, len(model.keys) + 1)[1:] for k in range(len(FEATURES))) / scale - 1e-4 * model.weights
        step_w += g * g
        model.weights += 0.5 * g / np.sqrt(step_w)
        gb = miss.sum() / scale
        step_b += gb * gb
        model.bias += 0.5 * gb / np.sqrt(step_b)
        gt = (truth - pairs) / scale
        step_t += gt * gt
        model.change += 0.1 * gt / np.sqrt(step_t)
    x = np.column_stack([np.ones(len(texts)), summary(marginals(model.emissions(columns), model.change, cut)[0], first)])
    w = np.zeros(4)
    for _ in range(25):  # Newton's steps with a ridge
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(4), x.T @ (toxic - q) - 0.5 * w)
    model.document = w
    heavy = np.abs(model.weights) > 1e-3
    return Model(model.keys[heavy], model.weights[heavy], model.bias, model.change, w)


OUT = "score double, offsets string"


def offsets_of(text: str, spans: list[tuple[int, int]]) -> str:
    """Byte spans as code points, start:end, comma-joined."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return ",".join(f"{at[a]}:{at[b]}" for a, b in spans)


def scores(texts: list[str], model: Model) -> tuple[np.ndarray, list[str]]:
    hashes, starts, ends, first, offsets = tokens(texts)
    p, _ = marginals(model.emissions(model.columns(hashes)), model.change, first)
    x = np.column_stack([np.ones(len(texts)), summary(p, first)])
    spans: list[str] = [""] * len(texts)
    bad = np.flatnonzero(p > 0.5)
    owner = np.searchsorted(offsets, starts[bad], side="right") - 1
    for i in np.unique(owner):
        mine = bad[owner == i]
        spans[i] = offsets_of(texts[i], [(starts[k] - offsets[i], ends[k] - offsets[i]) for k in mine])
    return 1 / (1 + np.exp(-x @ model.document)), spans


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most SAMPLE labelled texts of each kind, none of them held out: the first by hash of the text. Hashes and ids
    find them; only their own texts come to the driver."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high"))
    known = known.filter(F.col("toxic") == F.col("high")).select("doc_id", "toxic")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    text = whole("text")
    rows = docs.filter(F.length(text) > 0).select("doc_id", F.xxhash64(text).alias("hash")).join(known, "doc_id").distinct()
    few = rows.withColumn("salt", F.pmod("hash", F.lit(SALTS)))
    for keys in (["toxic", "salt"], ["toxic"]):  # the first of each label and salt, then of each label: 2 x SAMPLE rows
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "doc_id"))
        few = few.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE)
    few = few.select("doc_id", "hash", "toxic")
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(few), ["doc_id", "hash"])
    found = texts.select("toxic", "hash", "doc_id", "text").distinct().collect()
    return [(r["text"], r["toxic"]) for r in sorted(found, key=tuple)]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs as columns c0, c1, .. with score (double) and offsets (string: code points start:end of toxic words)."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = training_sample(docs, labels)
    y = np.array([s[1] for s in sample], dtype=float)
    model = fit([s[0] for s in sample], y) if 0 < y.sum() < len(y) else None
    del sample, y
    trim()  # the fit's arrays
    shipped = spark.sparkContext.broadcast(model)  # at most the features of 2 x SAMPLE texts
    place = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        import pyarrow as pa

        m = shipped.value
        for b in batches:
            found, where = np.zeros(b.num_rows), [""] * b.num_rows
            for i, j in runs(b.column(place), BATCH_BYTES) if m else []:
                found[i:j], where[i:j] = scores([t or "" for t in b.column(place).slice(i, j - i).to_pylist()], m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found), pa.array(where, pa.string())], names=[*names, "score", "offsets"])

    numbered = docs.toDF(*names)
    schema = T.StructType([*numbered.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offsets", T.StringType())])
    return numbered.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = scored(docs.select("doc_id", "text"), labels).withColumnRenamed("c0", "doc_id")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offsets")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects."""
    return scored(docs, labels).filter(F.col("score") < THRESHOLD).drop("score", "offsets").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
