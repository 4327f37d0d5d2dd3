"""Connected components by contraction, for graphs of any size and any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); nodes of one component share the root.

    Each round every node points to its neighbour of least hash (or itself), pointers are
    followed once more, and the edges are rewritten between roots.  Loops and repeats go,
    so the graph shrinks geometrically; a star of any degree takes two rounds.  All steps
    are partial aggregates and equi-joins; no neighbourhood is ever collected.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    left = durable(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct())
    label = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), F.col("m"))["n"].alias("p"))
        first = durable(first)
        second = first.select(F.col("u").alias("p"), F.col("p").alias("q"))
        parent = durable(first.join(second, "p").select("u", F.col("q").alias("p")))
        a, b = parent.select("u", F.col("p").alias("a")), parent.select(F.col("u").alias("v"), F.col("p").alias("b"))
        moved = left.join(a, "u").join(b, "v").where("a != b")
        left = durable(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        if label is None:
            label = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("u").alias("root"), F.col("p").alias("next"))
            label = durable(label.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0) if label is None else label
