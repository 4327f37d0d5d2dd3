"""Quantiles, cumulative shares and digests.

``quantile`` is exact.  ``histogram`` is a mergeable exact form, ``digest`` a mergeable
bounded one: a t-digest with the k1 size bound of the published algorithm.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keys(keys):
    return list(keys or [])


#: Parts that a range of values is cut into, how often, and the most rows that are sent to all tasks.
PARTS, ROUNDS, FEW = 1 << 14, 2, 200_000


def _nearby(targets: DataFrame) -> DataFrame:
    """Few rows as a table that is sent to all tasks, made once; more stay as they are and are joined."""
    rows = targets.limit(FEW + 1).toArrow()
    return F.broadcast(targets.sparkSession.createDataFrame(rows, targets.schema)) if rows.num_rows <= FEW else targets


def _extent() -> list:
    """How many values there are, the least and the largest of all and of the finite ones."""
    v = F.col("_v")
    x = v.cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)
    return [F.count(v).alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"), F.min(finite).alias("_a"), F.max(finite).alias("_b")]


def _same(keys: list[str]):
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in keys], F.lit(True))


def _within(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in a target's range, once for each such target."""
    near = targets.withColumnsRenamed({c: f"_t{c}" for c in keys})
    return rows.join(near, _same(keys) & F.col("_v").between(F.col("_low"), F.col("_high"))).drop(*(f"_t{c}" for c in keys))


def _cut(rows: DataFrame, targets: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, part, extent, upto): every range cut into parts, and the values counted up to each part's end."""
    v, a, b = (F.col(c).cast("double") * 0.5 for c in ("_v", "_a", "_b"))  # halves, so that no difference overflows
    share = F.coalesce(F.try_divide(v - a, b - a), F.lit(0.0))
    # it never falls as the value grows; infinite values and NaN are in the outer parts
    part = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (PARTS - 1))
    counts = _within(rows, targets, keys).groupBy(*by, part.alias("_part")).agg(*_extent())
    return counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")))


def _hit(counts: DataFrame) -> DataFrame:
    """The part, or value, that each target's rank falls into; the rank is then one within it."""
    before = F.col("_upto") - F.col("_n")
    return counts.where((F.col("_rank") > before) & (F.col("_rank") <= F.col("_upto"))).withColumn("_rank", F.col("_rank") - before)


def quantile(df: DataFrame, value: str, qs: list[float], keys=None) -> DataFrame:
    """(keys, q, quantile): the least value with a cumulative share of at least q; q is clamped to [0, 1].

    Exact, and no task holds a group: the range of its values is cut into parts, which are counted; a quantile's part
    is known from the counts and is cut again; the values of the part that is left are counted one by one.
    """
    qs = [min(1.0, max(0.0, float(q))) for q in qs]
    k, kind = _keys(keys), df.select(F.expr(f"percentile_disc(0.5D) within group (order by `{value}`)")).dtypes[0][1]
    names = [f"_k{j}" for j in range(len(k))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(k, names, strict=True)), F.col(value).cast(kind).alias("_v"))
    target, extent = [*names, "_q", "_rank"], ["_low", "_high", "_a", "_b"]
    groups = _nearby(rows.groupBy(*names).agg(*_extent()))
    # the first cut is the same for all quantiles of a group
    counts = _cut(rows, groups.select(*names, *extent), names, names).withColumn("_all", F.sum("_n").over(Window.partitionBy(*names)))
    each = counts.withColumn("_q", F.explode(F.array(*map(F.lit, sorted(set(qs)))))).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_q") * F.col("_all"))))
    targets = _nearby(_hit(each).select(*target, *extent))
    for _ in range(ROUNDS - 1):
        targets = _nearby(_hit(_cut(rows, targets, names, target)).select(*target, *extent))
    left = _within(rows, targets, names).groupBy(*target, "_v").agg(F.count("*").alias("_n"))
    found = _hit(left.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*target).orderBy("_v")))).select(*names, "_q", "_v")
    asked = groups.select(*names, F.explode(F.array(*map(F.lit, qs))).alias("q"))  # a group without values has nulls
    both = asked.join(found.withColumnsRenamed({c: f"_t{c}" for c in names}), _same(names) & (F.col("q") == F.col("_q")), "left")
    return both.select(*(F.col(n).alias(c) for c, n in zip(k, names, strict=True)), "q", F.col("_v").alias("quantile"))


def approximate_quantile(df: DataFrame, value: str, qs: list[float], keys=None, accuracy: int = 10_000) -> DataFrame:
    k = _keys(keys)
    wide = df.groupBy(*k).agg(F.percentile_approx(value, [float(q) for q in qs], accuracy).alias("v"))
    return wide.select(*k, F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("v").alias("quantile"))).alias("x")).select(*k, "x.q", "x.quantile")


def cdf(df: DataFrame, value: str, xs: list[float], keys=None) -> DataFrame:
    """(keys, x, cdf): the share at or below x, interpolated to the next value; 0 below the least, 1 above the largest."""
    k, v, aggs = _keys(keys), F.col(value), []
    for j, x in enumerate(xs):
        aggs += [F.count_if(v <= x).alias(f"i{j}"), F.max(F.when(v <= x, v)).alias(f"a{j}"), F.min(F.when(v > x, v)).alias(f"b{j}")]
    wide = df.groupBy(*k).agg(F.count(value).alias("n"), *aggs)
    one = lambda j, x: F.when(F.col(f"a{j}").isNull(), 0.0).when(F.col(f"b{j}").isNull(), 1.0).otherwise((F.col(f"i{j}") + (F.lit(float(x)) - F.col(f"a{j}")) / (F.col(f"b{j}") - F.col(f"a{j}"))) / F.col("n"))
    pairs = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.when(F.col("n") > 0, F.least(one(j, x), F.lit(1.0))).alias("cdf")) for j, x in enumerate(xs)))
    return wide.select(*k, F.explode(pairs).alias("p")).select(*k, "p.x", "p.cdf")


def summary(df: DataFrame, value: str, weight: str | None = None, keys=None) -> DataFrame:
    """(keys, weight, min, max, mean); weights of 0 or less don't count; nulls if nothing does."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.where(F.col(value).isNotNull() & (w > 0))
    return rows.groupBy(*_keys(keys)).agg(F.sum(w).alias("weight"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col(value) * w) / F.sum(w)).alias("mean"))


def histogram(df: DataFrame, value: str, keys=None) -> DataFrame:
    """(keys, v, n): the exact mergeable form."""
    return df.where(F.col(value).isNotNull()).groupBy(*_keys(keys), F.col(value).alias("v")).agg(F.count("*").alias("n"))


def merge_histograms(*parts: DataFrame, keys=None) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*_keys(keys), "v").agg(F.sum("n").alias("n"))


def histogram_quantile(parts: DataFrame, q: float, keys=None) -> DataFrame:
    k = _keys(keys)
    return parts.groupBy(*k).agg(F.expr(f"percentile(v, {q!r}D, n)").alias("interpolated"), F.sum("n").alias("n"))


# --- t-digest -----------------------------------------------------------------------------


def compress(means: np.ndarray, weights: np.ndarray, delta: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """Centroids merged while each spans at most one unit of k1(q) = delta / (2 pi) * asin(2 q - 1)."""
    if delta <= 0:
        delta = 100.0
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    total = weights.sum()
    if not total:
        return means[:0], weights[:0]
    scale = delta / (2 * math.pi)
    out_m, out_w, done = [], [], 0.0
    m, w, limit = means[0], weights[0], 0.0

    def bound(q: float) -> float:
        k = min(scale * math.asin(max(-1.0, min(1.0, 2 * q - 1))) + 1, delta / 4)
        return (math.sin(k / scale) + 1) / 2

    limit = bound(0.0)
    for x, y in zip(means[1:].tolist(), weights[1:].tolist(), strict=True):
        if (done + w + y) / total <= limit:
            w += y
            m += (x - m) * y / w
        else:
            out_m.append(m)
            out_w.append(w)
            done += w
            limit = bound(done / total)
            m, w = x, y
    return np.array([*out_m, m]), np.array([*out_w, w])


def digest(df: DataFrame, value: str, keys=None, delta: float = 100.0, weight: str | None = None) -> DataFrame:
    """(keys, means, weights, n, min, max): digests made by partition, then merged.

    A group reaches one task only as the digests of its partitions, each at most about
    ``delta`` centroids.
    """
    k = _keys(keys)
    rows = df.where(F.col(value).isNotNull()).select(*k, F.col(value).cast("double").alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("w > 0")
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in k), "means array<double>, weights array<double>, n double, min double, max double"])

    def partial(batches):
        held: dict[tuple, list] = {}
        for pdf in batches:
            for key, g in pdf.groupby(k, dropna=False) if k else [((), pdf)]:
                v, w = g["v"].to_numpy(), g["w"].to_numpy()
                old = held.get(key)
                m, c = compress(np.concatenate([old[0], v]) if old else v, np.concatenate([old[1], w]) if old else w, delta)
                held[key] = [m, c, (old[2] if old else 0) + w.sum(), min(v.min(), old[3] if old else v.min()), max(v.max(), old[4] if old else v.max())]
        if held:
            yield pd.DataFrame([(*(key if isinstance(key, tuple) else (key,)), *x) for key, x in held.items()], columns=[*k, "means", "weights", "n", "min", "max"])

    return merge_digests(rows.mapInPandas(partial, schema), keys=k, delta=delta)


def merge_digests(parts: DataFrame, keys=None, delta: float = 100.0) -> DataFrame:
    k = _keys(keys)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        m, w = compress(np.concatenate([*pdf["means"]]), np.concatenate([*pdf["weights"]]), delta)
        head = {c: [pdf[c].iloc[0]] for c in k}
        return pd.DataFrame({**head, "means": [m], "weights": [w], "n": [pdf["n"].sum()], "min": [pdf["min"].min()], "max": [pdf["max"].max()]})

    return parts.groupBy(*k).applyInPandas(final, parts.schema)


def digest_quantile(digests: DataFrame, qs: list[float], keys=None) -> DataFrame:
    """(keys, q, quantile) by interpolation between centroids' middles; 0 and 1 are the least and the largest."""
    k = _keys(keys)
    kinds = dict(digests.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in k), "q double, quantile double"])

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                w = np.asarray(r.weights)
                middle = (np.cumsum(w) - w / 2) / w.sum()
                xs, ys = np.concatenate(([0.0], middle, [1.0])), np.concatenate(([r.min], r.means, [r.max]))
                out += [(*(getattr(r, c) for c in k), q, float(np.interp(min(1.0, max(0.0, q)), xs, ys))) for q in qs]
            yield pd.DataFrame(out, columns=[*k, "q", "quantile"])

    return digests.mapInPandas(run, schema)
