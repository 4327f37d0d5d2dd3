"""Cuckoo filters as multisets of (bucket pair, fingerprint).

Relocation never changes what a filter answers: membership depends on the unordered pair
of buckets and the fingerprint.  The table is thus equal to a filter that does not
overflow, and it can be built in any order, merged, and deleted from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60

SLOTS = 4
_SPREAD = 0x5BD1E995


def buckets(capacity: int) -> int:
    """A power of two of at least capacity / 4 and 2."""
    return max(2, 1 << (max(1, -(-capacity // SLOTS)) - 1).bit_length())


def place(item: Column, capacity: int) -> Column:
    """Struct (b, fp): the lesser of an item's two buckets, and its 8-bit fingerprint."""
    mask = buckets(capacity) - 1
    h = h60(item.cast("string"))
    fp = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(255))
    fp = F.when(fp == 0, 1).otherwise(fp)
    first = h.bitwiseAND(F.lit(mask))
    second = first.bitwiseXOR((fp * _SPREAD).bitwiseAND(F.lit(mask)))
    return F.struct(F.least(first, second).alias("b"), fp.cast("int").alias("fp"))


def build(df: DataFrame, item: str, capacity: int, delta: str | None = None) -> DataFrame:
    """(b, fp, n): inserts, or inserts and deletes as +1 and -1 in ``delta``; only n > 0 is kept."""
    rows = df.where(F.col(item).isNotNull()).select(place(F.col(item), capacity).alias("p"), (F.col(delta) if delta else F.lit(1)).alias("d"))
    return rows.groupBy("p.b", "p.fp").agg(F.sum("d").alias("n")).where("n > 0")


def insert_unique(df: DataFrame, item: str, capacity: int) -> DataFrame:
    """Each distinct item once."""
    return build(df.select(item).distinct(), item, capacity)


def contains(table: DataFrame, probes: DataFrame, item: str, capacity: int) -> DataFrame:
    """(item, hit) for each distinct probe."""
    asked = probes.select(item).where(F.col(item).isNotNull()).distinct().select(item, place(F.col(item), capacity).alias("p")).select(item, "p.b", "p.fp")
    return asked.join(table, ["b", "fp"], "left").select(item, F.col("n").isNotNull().alias("hit"))


def replay(df: DataFrame, item: str, order: list[str], op: str, capacity: int) -> DataFrame:
    """Operations in order: (order, item, op, ok, n_after).  A delete without a match changes nothing and fails.

    Clamped running sums: before a place, the count is the sum so far less its lowest point
    below zero.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("b", "fp").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select("*", place(F.col(item), capacity).alias("p")).select(*df.columns, "p.b", "p.fp").withColumn("d", F.when(F.col(op) == "insert", 1).otherwise(-1))
    rows = rows.withColumn("s", F.sum("d").over(w))
    rows = rows.withColumn("after", F.col("s") - F.least(F.min("s").over(w), F.lit(0)))
    before = F.coalesce(F.lag("after").over(Window.partitionBy("b", "fp").orderBy(*order)), F.lit(0))
    return rows.select(*order, item, op, ((F.col("d") == 1) | (before > 0)).alias("ok"), F.col("after").alias("n_after"))


def load(table: DataFrame, capacity: int) -> DataFrame:
    """(count, load_factor)."""
    n = F.coalesce(F.sum("n"), F.lit(0))
    return table.agg(n.cast("long").alias("count"), (n / (buckets(capacity) * SLOTS)).alias("load_factor"))
