"""Heavy hitters: exact and bounded top lists, sequential Space-Saving, decayed rates."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decay import decayed_sum
from .ordered import fold_to_rows


def top(df: DataFrame, item: str, n: int) -> DataFrame:
    """(item, cnt): the n most frequent, ties by item."""
    counts = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.count("*").alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "item").limit(max(0, n))


def bounded_top(df: DataFrame, item: str, n: int, capacity: int = 100) -> DataFrame:
    """(item, cnt) from a mergeable sketch of ``capacity`` counters in each task."""
    capacity = capacity if capacity > 0 else 100
    row = df.select(F.explode(F.expr(f"approx_top_k(`{item}`, {n}, {capacity})")).alias("x"))
    return row.select("x.item", F.col("x.count").alias("cnt"))


class SpaceSaving:
    """The sequential summary: a tracked item counts up, a new one replaces the least counter."""

    def __init__(self, capacity: int = 100):
        self.capacity = capacity if capacity > 0 else 100
        self.counts: dict[str, list] = {}
        self.heap: list[tuple[int, str]] = []

    def add(self, item: str) -> None:
        if item in self.counts:
            self.counts[item][0] += 1
        elif len(self.counts) < self.capacity:
            self.counts[item] = [1, 0]
            heapq.heappush(self.heap, (1, item))
        else:
            while self.heap[0][0] != self.counts[self.heap[0][1]][0]:  # refresh what has grown
                _, old = self.heap[0]
                heapq.heapreplace(self.heap, (self.counts[old][0], old))
            least, old = self.heap[0]
            del self.counts[old]
            self.counts[item] = [least + 1, least]
            heapq.heapreplace(self.heap, (least + 1, item))

    def least(self) -> int:
        """The bound on an untracked item's count; 0 while there is room."""
        return min((c for c, _ in self.counts.values()), default=0) if len(self.counts) >= self.capacity else 0


def space_saving(df: DataFrame, item: str, order: list[str], capacity: int, keys: list[str]) -> DataFrame:
    """(keys, item, cnt, err): the summary of each key's items in their order, nulls last; rows are streamed."""

    def counters(s: SpaceSaving) -> list[tuple[str, int, int]]:
        return [(x, c, e) for x, (c, e) in s.counts.items()]

    rows = df.where(F.col(item).isNotNull()).select(*keys, *order, F.col(item).cast("string").alias("_item"))
    by = [F.col(c).asc_nulls_last() for c in order]
    return fold_to_rows(rows, keys, by, "_item", lambda: SpaceSaving(capacity), SpaceSaving.add, counters, "item string, cnt bigint, err bigint")


def count_of(counters: DataFrame, probes: DataFrame, item: str) -> DataFrame:
    """(item, cnt) of probes against a table (item, cnt); untracked ones are 0."""
    asked = probes.select(F.col(item).alias("item")).distinct()
    return asked.join(counters.select("item", "cnt"), "item", "left").select("item", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def rates(df: DataFrame, item: str, time: str, at, half_life: float) -> DataFrame:
    """(item, rate): every touch decayed to the instant ``at``."""
    return decayed_sum(df.withColumn("item", F.col(item)), ["item"], time, at, half_life)


def top_rates(df: DataFrame, item: str, time: str, at, half_life: float, n: int) -> DataFrame:
    """The n items of the highest decayed rate, ties by item."""
    return rates(df, item, time, at, half_life).orderBy(F.desc("rate"), "item").limit(max(0, n))


def rate_of(rates_: DataFrame, probes: DataFrame, item: str) -> DataFrame:
    asked = probes.select(F.col(item).alias("item")).distinct()
    return asked.join(rates_, "item", "left").select("item", F.coalesce("rate", F.lit(0.0)).alias("rate"))
