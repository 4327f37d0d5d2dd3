"""Sharding by balanced label propagation.

Documents start on a shard given by a hash.  Linked documents (equal texts) then move, in
rounds of Spark joins, to the shard where most of their neighbours are: moves to a shard are
granted up to its spare room under a capacity plus what leaves it, so sizes stay even while
edges are cut less and less.  A last step moves surplus rows, single
documents first, to shards with room, until row counts differ by at most one.

The state of the rounds is a table of cells: documents of one text that started on one
shard move together, so a text with any number of copies is at most ``shards`` cells.

Law ``rows``: shard counts are at most one apart.  Slots number each shard's rows from 0
without gaps.

Defined cases: a null text has no bytes, and all null and empty texts are equal texts;
repeated rows are placed one by one; fewer rows than shards leave shards empty; an empty
table gives an empty result; extra columns are ignored; ties go to the shard of greatest hash.
Capacity holds in expectation between rounds; the last step makes it exact, and may split a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_checked


@dataclass(frozen=True)
class Sharding:
    shards: int = 40
    rounds: int = 8
    #: Room above an even share that a shard may use between rounds, in %.
    slack_percent: int = 3
    #: Rows that one task numbers at once, about.
    slot_rows: int = 4000


def _chance(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)


def admitted(flows: dict[tuple[int, int], int], spare: list[float], k: int) -> list[float]:
    """By target: the share of the wished moves that fits into its spare room and what leaves it.

    What leaves depends on the other shards' shares; they are lowered from 1 until all agree.
    """
    share = [1.0] * k
    into = [sum(n for (_, t), n in flows.items() if t == j) for j in range(k)]
    for _ in range(50):
        out = [sum(n * share[t] for (s, t), n in flows.items() if s == j) for j in range(k)]
        share = [min(x, (spare[j] + out[j]) / into[j]) if into[j] else 1.0 for j, x in enumerate(share)]
    return [float(x) for x in share]


def propagate(cells: DataFrame, sizes: list[int], params: Sharding) -> DataFrame:
    """Labels of cells (g, s0, n) after the rounds: (g, s0, n, s)."""
    spark, k = cells.sparkSession, params.shards
    total = sum(sizes)
    cap = -(-total // k) * (100 + params.slack_percent) / 100
    cells = durable(cells.withColumn("s", F.col("s0")))
    fixed = None
    for step in range(params.rounds):
        here = cells.groupBy("g", "s").agg(F.sum("n").alias("n"))
        target = here.groupBy("g").agg(F.max_by("s", F.struct("n", F.xxhash64("g", "s"))).alias("t"))
        wish = durable(cells.join(target, "g"))
        flows = {(r["s"], r["t"]): r["n"] for r in wish.where("s != t").groupBy("s", "t").agg(F.sum("n").alias("n")).collect()}  # at most shards^2
        if not flows:
            break
        own = {r["s"]: r["n"] for r in wish.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        if fixed is None:  # rows without links stay where they are
            fixed = [sizes[j] - own.get(j, 0) for j in range(k)]
        spare = [max(0.0, cap - fixed[j] - own.get(j, 0)) for j in range(k)]
        share = admitted(flows, spare, k)
        table = spark.createDataFrame([(t, share[t], share[t] * sum(n for (_, x), n in flows.items() if x == t)) for t in range(k)], "t int, share double, quota double")
        moves = (F.col("s") != F.col("t")) & (F.col("n") <= F.col("quota")) & (_chance(F.col("g"), F.col("s0"), F.lit(step)) < F.col("share"))
        moved = wish.join(F.broadcast(table), "t")  # one row a shard
        cells = durable(moved.select("g", "s0", "n", F.when(moves, F.col("t")).otherwise(F.col("s")).alias("s")))
    return cells


def shard_documents(docs: DataFrame, params: Sharding = Sharding()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    k = params.shards
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.struct(F.xxhash64(data).alias("x"), F.crc32(data).alias("c"), F.octet_length(data).alias("b")).alias("g"))
    base = durable(base.withColumn("s0", F.pmod(F.xxhash64("doc_id", "g"), F.lit(k)).cast("int")))
    base = base.withColumn("uid", F.monotonically_increasing_id())  # stable: the rows are on disk
    sizes = [0] * k
    for r in base.groupBy("s0").count().collect():
        sizes[r["s0"]] = r["count"]
    total = sum(sizes)
    all_cells = base.groupBy("g", "s0").agg(F.count("*").alias("n"))
    linked = all_cells.groupBy("g").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("g")
    cells = propagate(durable(all_cells.join(linked, "g")), sizes, params)
    placed = durable(join_checked(base, cells.select("g", "s0", "s"), ["g", "s0"], "left").select("doc_id", "size", "text_crc32", "uid", F.coalesce("s", "s0").alias("s"), F.col("s").isNotNull().alias("linked")))
    return _level(placed, total, params)


def _level(placed: DataFrame, total: int, params: Sharding) -> DataFrame:
    """Number the rows of each shard, linked ones first, and move what is above the even share."""
    k = params.shards
    parts = max(1, -(-total // (k * params.slot_rows)))
    part = F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int") + F.when(F.col("linked"), 0).otherwise(parts)
    placed = placed.withColumn("part", part)
    counts = durable(placed.groupBy("s", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("s", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("s", "part").orderBy(F.xxhash64("uid"), "uid")
    ranked = placed.join(offsets, ["s", "part"]).withColumn("rank", F.row_number().over(inside) - 1 + F.col("offset"))
    held = [0] * k
    for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect():  # at most one row a shard
        held[r["s"]] = r["n"]
    larger = sorted(range(k), key=lambda j: (-held[j], j))[: total % k]
    quota = [total // k + (j in larger) for j in range(k)]
    shard, slot, surplus, room = F.col("s"), F.col("rank"), 0, 0
    starts, holes = [], []
    for j in range(k):
        starts.append(surplus)
        surplus += max(0, held[j] - quota[j])
        if quota[j] > held[j]:
            holes.append((room, room + quota[j] - held[j], j, held[j]))
            room += quota[j] - held[j]
    at = lambda values: F.array(*(F.lit(v).cast("long") for v in values))[F.col("s")]
    number = F.when(F.col("rank") >= at(quota), at(starts) + F.col("rank") - at(quota))
    ranked = ranked.withColumn("number", number)
    for a, b, j, first in holes:
        hit = (F.col("number") >= a) & (F.col("number") < b)
        shard, slot = F.when(hit, j).otherwise(shard), F.when(hit, F.col("number") - a + first).otherwise(slot)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
