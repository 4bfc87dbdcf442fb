"""Statistics over paired and grouped rows. Large inputs are aggregated in Spark; only sums go to the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col


def rank_counts(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """Mann-Whitney's U of two groups with Cliff's delta and the normal approximation's z with tie correction (STA-1,
    STA-2). Values are counted first, so the ranks run over distinct values and no window sees the rows."""
    c = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    t = F.col("a") + F.col("b")
    before = F.coalesce(F.sum(t).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = c.withColumn("rank", before + (t + 1) / 2)
    s = ranked.agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(t.cast("double") ** 3 - t).alias("ties"))
    n, m = F.col("n_first"), F.col("n_second")
    u = F.col("r") - n * (n + 1) / 2
    size = n + m
    spread = F.sqrt(n * m / 12 * ((size + 1) - F.col("ties") / (size * (size - 1))))
    return s.select("n_first", "n_second", u.alias("u"), (2 * u / (n * m) - 1).alias("cliffs_delta"), ((u - n * m / 2) / spread).alias("z"))


def hash_unit(*parts: Column) -> Column:
    """Uniform numbers in [0, 1) from keys; the same on every run and partitioning."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def replicated(rows: DataFrame, times: int, seed: int, names: list[str], sums) -> DataFrame:
    """b (0 to times - 1) and sums over all rows for each replicate. rows: key (a hash, long) and further columns; sums(u,
    columns) gives an array per name from the rows' uniform numbers of one replicate. Each task sends one row a replicate,
    so neither rows nor replicates are multiplied in a shuffle."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = np.zeros((times, len(names)))
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            for b in range(times):
                x = key ^ np.uint64((b * 0x9E3779B97F4A7C15 + seed * 0xD6E8FEB86659FD93) % 2**64)
                for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
                total[b] += [float(v.sum()) for v in sums(u, columns)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(times)), *[pa.array(total[:, i]) for i in range(len(names))]], names=["b", *names])

    parts = rows.mapInArrow(run, ", ".join(["b long", *[f"{n} double" for n in names]]))
    return parts.groupBy("b").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_mean(df: DataFrame, value: str, key: str, times: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean by Poisson bootstrap (STA-3): each row gets a Poisson(1) weight per replicate from
    a hash of its key, and the replicates' sums are all that leaves a task."""
    cuts, p = [], 0.0
    for k in range(7):
        p += math.exp(-1) / math.factorial(k)
        cuts.append(p)

    def sums(u, columns):
        import numpy as np

        weight = np.searchsorted(cuts, u, side="right")
        return weight * columns[0], weight

    rows = df.filter(F.col(value).isNotNull()).select(F.xxhash64(key).alias("key"), F.col(value).cast("double").alias("v"))
    means = replicated(rows, times, seed, ["s", "w"], sums).select((F.col("s") / F.nullif(F.col("w"), F.lit(0.0))).alias("mean"))
    return means.agg(F.count("mean").alias("replicates"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def sign_flip(df: DataFrame, difference: str, key: str, times: int = 500, seed: int = 7) -> DataFrame:
    """Two-sided sign-flip permutation p-value of a mean difference, (extreme + 1) / (n + 1) (STA-4)."""

    def sums(u, columns):
        import numpy as np

        return np.where(u < 0.5, columns[0], -columns[0]), columns[0]

    rows = df.filter(F.col(difference).isNotNull()).select(F.xxhash64(key).alias("key"), F.col(difference).cast("double").alias("v"))
    found = replicated(rows, times, seed, ["s", "own"], sums)
    return found.agg(((F.count_if(F.abs("s") >= F.abs("own") - 1e-12) + 1) / (F.lit(times) + 1)).alias("p"))


def benjamini_hochberg(df: DataFrame, p: str, key: str) -> DataFrame:
    """Adjusted p-values (STA-5, WIN-12). df: one row per test."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col(p), F.col(key)))
    ranked = df.withColumn("__rank", rank).withColumn("__raw", F.col(p) * n / F.col("__rank"))
    back = Window.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), F.min("__raw").over(back))).drop("__rank", "__raw")


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided p-value of discordant counts (STA-6)."""
    n, k = b + c, min(b, c)
    if not n:
        return 1.0
    if n < 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * sum(map(math.exp, logs)))


def discordant(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts of rows where exactly one of two tests holds."""
    return df.agg(F.count_if(F.col(first) & ~F.col(second)).alias("only_first"), F.count_if(~F.col(first) & F.col(second)).alias("only_second"))


def kappa(df: DataFrame, first: str, second: str) -> DataFrame:
    """Agreement and Cohen's kappa of two label columns (STA-7). Marginals come from the joint counts."""
    joint = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("x"), F.col(second).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    marks = joint.select(F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col("y").alias("v"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))).alias("s"))
    chance = marks.groupBy("s.v").agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b")).agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    total = joint.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    both = total.join(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("ab") / F.col("n") / F.col("n")
    return both.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)).alias("kappa"))


def line(df: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    """Least-squares slope, intercept and R squared (MTH-4)."""
    agg = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n")]
    return df.groupBy(*by).agg(*agg) if by else df.agg(*agg)


def transitions(df: DataFrame, first: str, second: str, labels: list[str]) -> DataFrame:
    """Counts of all label pairs, zeros included (AGG-21)."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "x string, y string")
    n = df.groupBy(F.col(first).alias("x"), F.col(second).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"))


def principal(df: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """df with columns pc1.. of the features scaled to mean 0 and population deviation 1; each component's largest loading is
    positive (STA-12). Sums of squares and products come from one aggregation; only a features x features matrix is solved."""
    import numpy as np

    n = len(features)
    pairs = [F.sum(F.col(features[i]).cast("double") * F.col(features[j])).alias(f"p{i}_{j}") for i in range(n) for j in range(i, n)]
    got = df.select(*features).dropna().agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)], *pairs).first()
    total = max(got["n"], 1)
    mean = np.array([(got[f"s{i}"] or 0) / total for i in range(n)])
    cov = np.array([[(got[f"p{min(i, j)}_{max(i, j)}"] or 0) / total - mean[i] * mean[j] for j in range(n)] for i in range(n)])
    deviation = np.sqrt(np.clip(np.diag(cov), 0, None))
    deviation[deviation == 0] = 1
    values, vectors = np.linalg.eigh(cov / np.outer(deviation, deviation))
    chosen = vectors[:, np.argsort(-values)[:k]]
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), range(chosen.shape[1])])
    out = {f"pc{c + 1}": sum(((F.col(f) - float(mean[i])) / float(deviation[i]) * float(chosen[i, c]) for i, f in enumerate(features)), F.lit(0.0)) for c in range(chosen.shape[1])}
    return df.withColumns(out)


def dispersion(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Mean distance to the group's centroid and its size (STA-13)."""
    centre = df.groupBy(group).agg(*[F.avg(f).alias(f"c_{f}") for f in features])
    far = F.sqrt(sum(((F.col(f) - F.col(f"c_{f}")) ** 2 for f in features), F.lit(0.0)))
    return df.join(centre, group).select(group, far.alias("distance")).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"))


def dispersion_test(df: DataFrame, group: str, features: list[str], key: str, times: int = 200, seed: int = 7) -> DataFrame:
    """Pseudo-F of distances to centroids and its permutation p-value (STA-13). Labels are dealt anew by hash order in
    proportion to the groups' sizes: each replicate needs sums by (replicate, group) only."""
    centre = df.groupBy(group).agg(*[F.avg(f).alias(f"c_{f}") for f in features])
    far = F.sqrt(sum(((F.col(f) - F.col(f"c_{f}")) ** 2 for f in features), F.lit(0.0)))
    d = df.join(centre, group).select(F.col(group).alias("g"), F.col(key).alias("k"), far.alias("d"))
    sizes = [(r["g"], r["n"]) for r in d.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy("g").collect()]  # one row per group
    total, at = sum(n for _, n in sizes), 0.0
    dealt = F.lit(sizes[-1][0])
    u = hash_unit(F.lit(seed), F.col("b"), F.col("k"))
    bounds = []
    for g, n in sizes[:-1]:
        at += n / total
        bounds.append((at, g))
    for at, g in reversed(bounds):
        dealt = F.when(u < at, g).otherwise(dealt)
    rows = d.select("g", "k", "d", F.explode(F.sequence(F.lit(0), F.lit(times))).alias("b"))
    sums = rows.groupBy("b", F.when(F.col("b") == 0, F.col("g")).otherwise(dealt).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") ** 2).alias("q"))
    between = F.sum(F.col("s") ** 2 / F.col("n")) - F.sum("s") ** 2 / F.sum("n")
    within = F.sum(F.col("q") - F.col("s") ** 2 / F.col("n"))
    k = len(sizes)
    ratio = F.try_divide(between / max(k - 1, 1), within / (F.sum("n") - k))
    f = sums.groupBy("b").agg(F.when(within > 1e-9, ratio).otherwise(F.lit(float("inf"))).alias("f"))
    own = F.max(F.when(F.col("b") == 0, F.col("f"))).over(Window.partitionBy())
    return f.withColumn("own", own).agg(F.first("own").alias("pseudo_f"), ((F.count_if((F.col("b") > 0) & (F.col("f") >= F.col("own"))) + 1) / (F.lit(times) + 1)).alias("p"))


def paired(df: DataFrame, keys: list[str], condition: str, value: str, first: str, second: str) -> DataFrame:
    """Mean of a value under two conditions by key, both there, and their difference (JOI-7, STA-10)."""
    g = df.groupBy(*keys).agg(F.avg(F.when(F.col(condition) == first, col(value))).alias("first"), F.avg(F.when(F.col(condition) == second, col(value))).alias("second"))
    return g.filter(F.col("first").isNotNull() & F.col("second").isNotNull()).withColumn("difference", F.col("first") - F.col("second"))


def label_vector(units: DataFrame, key: str, labels: str) -> DataFrame:
    """Per key and label, how often the label stands in its units, divided by the units: key, label, share (STA-9). units: one
    row per unit with an array of labels."""
    n = units.groupBy(key).agg(F.count(F.lit(1)).alias("n_units"))
    per = units.select(key, F.explode(labels).alias("label")).groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    return per.join(n, key).select(key, "label", (F.col("n") / F.col("n_units")).alias("share"))


def set_shift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Per key of both sides: values added and removed (sorted, joined by |), whether any were, and the Jaccard distance
    of the two sets, 0 for two empty ones (STA-14). One row per value on either side; null for a key without values."""
    a = before.groupBy(key).agg(F.collect_set(value).alias("b"))
    b = after.groupBy(key).agg(F.collect_set(value).alias("a"))
    names = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), "|")
    union, shared = F.size(F.array_union("a", "b")), F.size(F.array_intersect("a", "b"))
    j = a.join(b, key)
    return j.select(key, names("a", "b").alias("added"), names("b", "a").alias("removed"), (union != shared).alias("shifted"), F.when(union > 0, 1 - shared / union).otherwise(0.0).alias("distance"))


def agreement(before: DataFrame, after: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """Per key, over the parts that both sides have: how many, the share whose value agrees and whether any differs (STA-14)."""
    a, b = before.select(*keys, part, F.col(value).alias("__a")), after.select(*keys, part, F.col(value).alias("__b"))
    same = F.col("__a").eqNullSafe(F.col("__b"))
    return a.join(b, [*keys, part]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("int")).alias("agreement"), F.bool_or(~same).alias("shifted"))


def usage_projection(samples: DataFrame, plan: DataFrame, by: str, size: str, prompt: str, completion: str, effort: str, per_prompt: float, per_completion: float) -> DataFrame:
    """Requests, tokens and cost of a plan from a sample's fits: prompt tokens by a line in the input's size per `by`,
    completions by their mean per (`by`, effort) (STA-15). The fits are a row per group and broadcast."""
    fit = line(samples, prompt, size, by).select(by, "slope", "intercept")
    mean = samples.groupBy(by, effort).agg(F.avg(completion).alias("mean"), F.min(completion).alias("low"), F.max(completion).alias("high"))
    j = plan.join(F.broadcast(fit), by).join(F.broadcast(mean), [by, effort])
    tokens = F.greatest(F.lit(1), F.round(F.col("intercept") + F.col("slope") * F.col(size)).cast("long"))
    g = j.groupBy(effort).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("prompt_tokens"), F.sum(F.round("mean").cast("long")).alias("completion_tokens"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    return g.withColumn("cost", F.col("prompt_tokens") * per_prompt + F.col("completion_tokens") * per_completion)
