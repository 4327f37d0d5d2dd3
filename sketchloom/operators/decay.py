"""Exponential decay and smoothing.

A decayed rate at an instant is a plain two-phase sum: every event contributes its value
times exp(-lambda * age).  Moving averages are ordered folds; long series are folded in
closed form over sorted arrays inside the JVM, or streamed in Arrow batches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import fold

#: Smoothing factors of the 1, 5 and 15 minute averages at ticks of 5 seconds.
ALPHA_1, ALPHA_5, ALPHA_15 = (1 - math.exp(-5 / s) for s in (60, 300, 900))


def half_life_or_default(seconds: float) -> float:
    return seconds if seconds > 0 else 60.0


def interval_or_default(seconds: float) -> float:
    return seconds if seconds > 0 else 5.0


def _micros(x) -> Column:
    return F.unix_micros(x if isinstance(x, Column) else F.lit(x).cast("timestamp"))


def decayed_sum(df: DataFrame, keys: list[str], time: str, at, half_life: float, value: str | None = None) -> DataFrame:
    """(keys, rate) at the instant ``at``; later events don't count."""
    rate = math.log(2) / half_life_or_default(half_life)
    age = (_micros(at) - _micros(F.col(time))) / 1e6
    n = F.col(value) if value else F.lit(1.0)
    rows = df.where(F.col(time) <= (at if isinstance(at, Column) else F.lit(at).cast("timestamp")))
    return rows.groupBy(*keys).agg(F.sum(n * F.exp(F.lit(-rate) * age)).alias("rate"))


def seeded_rate(df: DataFrame, keys: list[str], time: str, at, half_life: float, seeds: DataFrame, value: str | None = None) -> DataFrame:
    """``decayed_sum`` from forced states: ``seeds`` has keys, ``time`` and ``rate`` and hides earlier events of its key."""
    n = F.col(value).cast("double") if value else F.lit(1.0)
    s = seeds.select(*keys, F.col(time).alias("_t"), F.col("rate").alias("_r"))
    later = df.join(s, keys, "left").where(F.col("_t").isNull() | (F.col(time) > F.col("_t"))).select(*keys, time, n.alias("_n"))
    forced = s.select(*keys, F.col("_t").alias(time), F.col("_r").cast("double").alias("_n"))
    return decayed_sum(later.unionByName(forced), keys, time, at, half_life, "_n")


def running_rate(df: DataFrame, keys: list[str], time: str, tie: str, half_life: float, value: str | None = None) -> DataFrame:
    """Each event with its key's rate just after it (``rate``); late events add without decay."""
    lam = math.log(2) / half_life_or_default(half_life)

    def step(state: list, now: int, n: float | None = 1.0):
        rate, last = state
        if last is not None and now > last:
            rate *= math.exp(-lam * (now - last) / 1e6)
        state[:] = rate + (n or 0.0), now if last is None else max(last, now)
        return (state[0],)

    return fold(df, keys, [time, tie], [time, value] if value else [time], lambda: [0.0, None], step, "rate double")


def ewma_of_values(df: DataFrame, keys: list[str], value: str, order: list[str], alpha: float) -> DataFrame:
    """(keys, ewma): the first value starts, then r = alpha * v + (1 - alpha) * r, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    fold = F.aggregate(rows, F.lit(None).cast("double"), lambda a, x: F.coalesce(alpha * x["_v"] + (1 - alpha) * a, x["_v"]))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(fold.alias("ewma"))


def ticks(df: DataFrame, keys: list[str], time: str, interval: int, until=None) -> DataFrame:
    """(keys, tick, n): events by interval, empty ones included, from each key's first to its last (or ``until``)."""
    tick = F.floor(F.unix_micros(F.col(time)) / (interval * 1_000_000)).cast("long")
    counts = df.groupBy(*keys, tick.alias("tick")).agg(F.count("*").alias("n"))
    last = F.max("tick") if until is None else F.floor(_micros(until) / (interval * 1_000_000)).cast("long")
    spans = counts.groupBy(*keys).agg(F.min("tick").alias("a"), last.alias("b"))
    every = spans.select(*keys, F.explode(F.sequence("a", "b")).alias("tick"))
    return every.join(counts, [*keys, "tick"], "left").select(*keys, "tick", F.coalesce("n", F.lit(0)).alias("n"))


def moving_averages(df: DataFrame, keys: list[str], time: str, interval: int = 5, alphas: dict[str, float] | None = None) -> DataFrame:
    """(keys, one column by average): rates a second over ticks, the first tick starting each average.

    Empty ticks are not made: between two ticks with events, r shrinks by (1 - alpha) for
    each empty one, so the fold runs over the ticks that have events only.
    """
    interval = int(interval_or_default(interval))
    alphas = alphas or {"m1": ALPHA_1, "m5": ALPHA_5, "m15": ALPHA_15}
    tick = F.floor(F.unix_micros(F.col(time)) / (interval * 1_000_000)).cast("long")
    counts = df.groupBy(*keys, tick.alias("tick")).agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("tick", "n")))

    def step(a: Column, x: Column) -> Column:
        gap = (x["tick"] - a["tick"] - 1).cast("double")
        rate = x["n"] / F.lit(float(interval))
        one = lambda k, al: F.when(a["tick"].isNull(), rate).otherwise(al * rate + (1 - al) * a[k] * F.pow(F.lit(1 - al), gap))
        return F.struct(x["tick"].alias("tick"), *(one(k, al).alias(k) for k, al in alphas.items()))

    start = F.struct(F.lit(None).cast("long").alias("tick"), *(F.lit(0.0).alias(k) for k in alphas))
    folded = counts.groupBy(*keys).agg(F.aggregate(rows, start, step).alias("x"))
    return folded.select(*keys, F.col("x.tick").alias("last_tick"), *(F.col(f"x.{k}").alias(k) for k in alphas))


def running_ewma(df: DataFrame, keys: list[str], value: str, order: list[str], alpha: float) -> DataFrame:
    """Each row with its key's average just after it (``ewma``); a null value leaves it as it was."""

    def step(state: list, v: float | None):
        if v is not None:
            state[0] = float(v) if state[0] is None else alpha * float(v) + (1 - alpha) * state[0]
        return (state[0],)

    return fold(df, keys, order, [value], lambda: [None], step, "ewma double")
