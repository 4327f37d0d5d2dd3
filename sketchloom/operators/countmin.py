"""Count-min as a table of cells (row, bucket, count) that carries its dimensions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h60


class DimensionMismatch(ValueError):
    pass


def dimensions(epsilon: float, delta: float) -> tuple[int, int]:
    """(width, depth); epsilon <= 0 means 0.001, delta outside (0, 1) means 0.01."""
    epsilon = epsilon if epsilon > 0 else 0.001
    delta = delta if 0 < delta < 1 else 0.01
    return repaired(math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta)))


def repaired(width: int, depth: int) -> tuple[int, int]:
    return (width if width >= 1 else 272), (depth if depth >= 1 else 5)


def bounds(width: int, depth: int) -> tuple[float, float]:
    """(epsilon, delta) that the dimensions stand for."""
    return math.e / width, math.exp(-depth)


def _hashed(items: DataFrame, width: int, depth: int, *columns: str) -> DataFrame:
    rows = items.select("item", *columns, F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row_id"))
    return rows.withColumn("bucket", F.pmod(h60(F.concat_ws(":", "row_id", "item")), F.lit(width)))


def sketch(df: DataFrame, item: str, width: int = 272, depth: int = 5, n: str | None = None) -> DataFrame:
    """(row_id, bucket, cnt, width, depth).  Items are summed before they are hashed, so each is hashed once a row."""
    width, depth = repaired(width, depth)
    sums = df.where(F.col(item).isNotNull()).groupBy(F.col(item).cast("string").alias("item")).agg(F.sum(F.col(n) if n else F.lit(1)).cast("long").alias("n"))
    cells = _hashed(sums, width, depth, "n").groupBy("row_id", "bucket").agg(F.sum("n").alias("cnt"))
    return cells.withColumns({"width": F.lit(width), "depth": F.lit(depth)})


def counts(cells: DataFrame, probes: DataFrame, item: str, width: int = 272, depth: int = 5) -> DataFrame:
    """(item, estimate) for each distinct probe: the least cell, never below the true count."""
    width, depth = repaired(width, depth)
    asked = _hashed(probes.select(F.col(item).cast("string").alias("item")).where("item is not null").distinct(), width, depth)
    found = asked.join(cells, ["row_id", "bucket"], "left")
    return found.groupBy("item").agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def merge(*sketches: DataFrame) -> DataFrame:
    """Cells added up; raises DimensionMismatch unless all sketches have the same dimensions."""
    every = reduce(DataFrame.unionByName, sketches)
    if every.select("width", "depth").distinct().limit(2).count() > 1:
        raise DimensionMismatch("sketches differ in dimensions")
    return every.groupBy("row_id", "bucket").agg(F.sum("cnt").alias("cnt"), F.first("width").alias("width"), F.first("depth").alias("depth"))


def total(cells: DataFrame, width: int = 272) -> DataFrame:
    """(total, error): all that was added, and the error bound floor(epsilon * total)."""
    n = F.coalesce(F.sum("cnt"), F.lit(0))
    return cells.where("row_id = 0").agg(n.alias("total"), F.floor(F.lit(math.e / width) * n).cast("long").alias("error"))
