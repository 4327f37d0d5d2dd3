"""HyperLogLog as a table of registers: built by a two-phase aggregate, merged by max.

The estimate uses linear counting for small ranges and no correction for large ones, which
a 60-bit hash does not need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, h60


class PrecisionMismatch(ValueError):
    pass


def precision(p: int) -> int:
    """4 to 18; anything else means 14."""
    return p if 4 <= p <= 18 else 14


def alpha(p: int) -> float:
    m = 1 << precision(p)
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def registers(df: DataFrame, item: str, p: int = 14, keys: list[str] | None = None) -> DataFrame:
    """(keys, p, idx, rho); null items are not counted."""
    bits = HASH_BITS - precision(p)
    h = h60(F.col(item).cast("string"))
    rest = h.bitwiseAND(F.lit((1 << bits) - 1))
    rho = F.when(rest == 0, bits + 1).otherwise(bits - F.length(F.bin(rest)) + 1)
    hashed = df.where(F.col(item).isNotNull()).select(*(keys or []), F.shiftrightunsigned(h, bits).cast("int").alias("idx"), rho.cast("int").alias("rho"))
    return hashed.groupBy(*(keys or []), "idx").agg(F.max("rho").alias("rho")).withColumn("p", F.lit(precision(p)))


def merge(*sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The union of sketches of one precision, as one sketch (for each of the keys)."""
    if not sketches:
        raise ValueError("nothing to merge")
    if len({s.select("p").first()["p"] for s in sketches if not s.isEmpty()}) > 1:
        raise PrecisionMismatch("sketches differ in precision")
    both = reduce(DataFrame.unionByName, sketches)
    return both.groupBy(*(keys or []), "idx").agg(F.max("rho").alias("rho"), F.max("p").alias("p"))


def rollup(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser sketches from finer ones, e.g. by month from by day."""
    return merge(sketches, keys=keys)


def estimate(sketch: DataFrame, p: int = 14, keys: list[str] | None = None) -> DataFrame:
    """(keys, estimate) as a long; absent registers are 0.  Without keys an empty sketch is one row of 0."""
    m, a = float(1 << precision(p)), alpha(p)
    sums = sketch.groupBy(*(keys or [])).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(0.0)).alias("s"), F.count("*").alias("k"))
    raw = F.lit(a * m * m) / (F.col("s") + (F.lit(m) - F.col("k")))
    zeros = F.lit(m) - F.col("k")
    counted = F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(m) * F.log(F.lit(m) / zeros)).otherwise(raw)
    return sums.select(*(keys or []), F.floor(counted).cast("long").alias("estimate"))


def first_seen(df: DataFrame, item: str, time: str, tie: str) -> DataFrame:
    """The first event of each item: what a rate of uniques adds up."""
    order = F.struct(time, tie)
    return df.groupBy(item).agg(F.min(order).alias("o")).select(item, F.col(f"o.{time}").alias(time), F.col(f"o.{tie}").alias(tie))
