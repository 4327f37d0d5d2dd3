"""Bloom filters as tables of set bits; joins that filter by them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60

_HALF = (1 << 30) - 1


@dataclass(frozen=True)
class Bloom:
    bits: int
    hashes: int

    @staticmethod
    def sized(n: int, p: float) -> Bloom:
        """For n elements at false-positive rate p; bits are rounded up to a power of two, at least 64."""
        if n < 1 or not 0 < p < 1:
            raise ValueError("n must be positive and p inside (0, 1)")
        least = math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)
        return Bloom(max(64, 1 << (least - 1).bit_length()), max(1, round(least / n * math.log(2))))

    def positions(self, item: Column) -> Column:
        """The bits of an item by double hashing with two 30-bit halves of one hash."""
        h = h60(item.cast("string"))
        h1, h2 = F.shiftrightunsigned(h, 30), h.bitwiseAND(F.lit(_HALF))
        return F.transform(F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda i: (h1 + i.cast("long") * h2).bitwiseAND(F.lit(self.bits - 1)))


def build(df: DataFrame, item: str, f: Bloom) -> DataFrame:
    """(pos): the set bits; items are made distinct before they are hashed."""
    return df.select(item).where(F.col(item).isNotNull()).distinct().select(F.explode(f.positions(F.col(item))).alias("pos")).distinct()


def contains(bits: DataFrame, probes: DataFrame, item: str, f: Bloom) -> DataFrame:
    """(item, hit) for each distinct probe: hit if all its bits are set."""
    asked = probes.select(item).where(F.col(item).isNotNull()).distinct().select(item, F.explode(F.array_distinct(f.positions(F.col(item)))).alias("pos"))
    found = asked.join(bits.withColumn("bit", F.lit(True)), "pos", "left")
    return found.groupBy(item).agg(F.bool_and(F.coalesce("bit", F.lit(False))).alias("hit"))


def semi_join(df: DataFrame, bits: DataFrame, item: str, f: Bloom, anti: bool = False) -> DataFrame:
    """The rows whose item may be (with ``anti``: surely isn't) in the filter; null items never are."""
    hits = contains(bits, df, item, f).where("hit").select(item)
    return df.join(hits, item, "left_anti" if anti else "left_semi")


def estimated_count(bits: DataFrame, f: Bloom) -> DataFrame:
    """(estimate): elements that set so many bits; null if all bits are set."""
    x = F.count("*")
    share = F.lit(-f.bits / f.hashes) * F.log(1 - x / F.lit(float(f.bits)))
    return bits.agg(F.when(x < f.bits, F.floor(share + 1e-9)).cast("long").alias("estimate"))
