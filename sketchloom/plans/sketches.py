"""Queries of the synopses: cardinality, frequency, membership, quantiles, heavy hitters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import bloom, countmin, cuckoo, heavy_hitters, hll, quantiles
from ..sources.tables import load
from .registry import h60_sql, query

NOW = "2024-01-31 00:00:00"
DAY = 86400.0


def _registers_sql(keys: str, item: str, source: str, p: int) -> str:
    bits = 60 - p
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}(h >> {bits})::INT AS idx,
  max(CASE WHEN (h & {(1 << bits) - 1}) = 0 THEN {bits + 1} ELSE {bits + 1} - length(bin(h & {(1 << bits) - 1})) END)::INT AS rho
  FROM (SELECT {k}{h60_sql(f"{item}::VARCHAR")} AS h FROM {source} WHERE {item} IS NOT NULL) GROUP BY ALL"""


def _estimate_sql(keys: str, registers: str, p: int) -> str:
    m, k = 1 << p, f"{keys}, " if keys else ""
    raw = f"{hll.alpha(p) * m * m!r} / (sum(pow(2.0, -rho)) + ({m}.0 - count(*)))"
    return f"""SELECT {k}floor(CASE WHEN {raw} <= {2.5 * m} AND count(*) < {m} THEN {m}.0 * ln({m}.0 / ({m}.0 - count(*))) ELSE {raw} END)::BIGINT AS estimate
  FROM ({registers}) {f"GROUP BY {keys}" if keys else ""}"""


@query(f"SELECT *, 14 AS p FROM ({_registers_sql('', 'l_partkey', 'lineitem', 14)})")
def hll_2_registers(spark, sf):
    return hll.registers(load(spark, sf, "lineitem"), "l_partkey", 14)


@query(_estimate_sql("l_returnflag", _registers_sql("l_returnflag", "l_partkey", "lineitem", 12), 12))
def hll_3_estimate(spark, sf):
    keys = ["l_returnflag"]
    return hll.estimate(hll.registers(load(spark, sf, "lineitem"), "l_partkey", 12, keys), 12, keys)


@query(_estimate_sql("", "SELECT idx, max(rho) AS rho FROM (" + _registers_sql("o_orderstatus", "o_custkey", "orders", 12) + ") WHERE o_orderstatus IN ('O', 'F') GROUP BY idx", 12))
def hll_4_merge(spark, sf):
    orders = load(spark, sf, "orders")
    parts = [hll.registers(orders.where(F.col("o_orderstatus") == s), "o_custkey", 12) for s in "OF"]
    return hll.estimate(hll.merge(*parts), 12)


@query(_estimate_sql("month", _registers_sql("month", "user_id", "(SELECT *, strftime(ts, '%Y-%m') AS month FROM events)", 14), 14))
def hll_5_rollup(spark, sf):
    events = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    daily = hll.registers(events, "user_id", 14, ["day"])
    return hll.estimate(hll.rollup(daily.withColumn("month", F.date_format("day", "yyyy-MM")), ["month"]), 14, ["month"])


@query(f"""SELECT round(sum(exp(-ln(2) / {DAY} * (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6)), 6) AS rate
FROM (SELECT user_id, min(ts) AS ts FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id)""")
def hll_7_unique_rate(spark, sf):
    first = hll.first_seen(load(spark, sf, "events"), "user_id", "ts", "event_id")
    return heavy_hitters.decayed_sum(first, [], "ts", NOW, DAY).select(F.round("rate", 6).alias("rate"))


@query()
def hll_native(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("estimate"))


@query()
def hll_native_sketch(spark, sf):
    daily = load(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", 12).alias("s"))
    return daily.groupBy(F.trunc("day", "month").alias("month")).agg(F.hll_sketch_estimate(F.hll_union_agg("s", False)).alias("estimate"))


def _cells_sql(item: str, source: str, n: str = "1") -> str:
    return f"SELECT row_id::INT AS row_id, {h60_sql(f'''row_id || ':' || {item}::VARCHAR''')} % 272 AS bucket, sum({n})::BIGINT AS cnt FROM {source}, range(0, 5) r(row_id) WHERE {item} IS NOT NULL GROUP BY ALL"


@query(_cells_sql("l_partkey", "lineitem"))
def cm_2_cells(spark, sf):
    return countmin.sketch(load(spark, sf, "lineitem"), "l_partkey").select("row_id", "bucket", "cnt")


@query(f"""WITH cells AS ({_cells_sql("user_id", "events")}), probes AS (SELECT DISTINCT user_id::VARCHAR AS item FROM events)
SELECT item, min(coalesce(cnt, 0)) AS estimate FROM probes CROSS JOIN range(0, 5) r(row_id)
LEFT JOIN cells ON cells.row_id = r.row_id AND bucket = {h60_sql("r.row_id || ':' || item")} % 272 GROUP BY item""")
def cm_3_counts(spark, sf):
    events = load(spark, sf, "events")
    return countmin.counts(countmin.sketch(events, "user_id"), events, "user_id")


@query(f"SELECT sum(l_linenumber)::BIGINT AS total, floor({math.e / 272!r} * sum(l_linenumber))::BIGINT AS error FROM lineitem WHERE l_partkey IS NOT NULL")
def cm_4_total(spark, sf):
    return countmin.total(countmin.sketch(load(spark, sf, "lineitem"), "l_partkey", n="l_linenumber"), 272)


@query(_cells_sql("l_partkey", "lineitem"))
def cm_5_merge(spark, sf):
    lines = load(spark, sf, "lineitem")
    parts = [countmin.sketch(lines.where(F.pmod("l_orderkey", F.lit(3)) == k), "l_partkey") for k in range(3)]
    return countmin.merge(*parts).select("row_id", "bucket", "cnt")


@query(f"SELECT event_type, user_id, round(sum(value * exp(-ln(2) / {DAY} * (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6)), 4) AS rate FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY ALL")
def cm_8_rate(spark, sf):
    rates = heavy_hitters.decayed_sum(load(spark, sf, "events"), ["event_type", "user_id"], "ts", NOW, DAY, "value")
    return rates.withColumn("rate", F.round("rate", 4))


_BLOOM = bloom.Bloom.sized(3000, 0.01)
_BITS = f"SELECT DISTINCT ((h >> 30) + i * (h & 1073741823)) & {_BLOOM.bits - 1} AS pos FROM (SELECT {h60_sql('l_partkey::VARCHAR')} AS h FROM lineitem WHERE l_quantity > 49), range(0, {_BLOOM.hashes}) r(i)"
_HITS = f"""SELECT p_partkey, bool_and(b.pos IS NOT NULL) AS hit
FROM (SELECT p_partkey, {h60_sql('p_partkey::VARCHAR')} AS h FROM part) CROSS JOIN range(0, {_BLOOM.hashes}) r(i)
LEFT JOIN ({_BITS}) b ON b.pos = (((h >> 30) + i * (h & 1073741823)) & {_BLOOM.bits - 1}) GROUP BY p_partkey"""


def _bits(spark, sf):
    return bloom.build(load(spark, sf, "lineitem").where("l_quantity > 49"), "l_partkey", _BLOOM)


@query(_BITS)
def bf_2_bits(spark, sf):
    return _bits(spark, sf)


@query(_HITS)
def bf_3_contains(spark, sf):
    return bloom.contains(_bits(spark, sf), load(spark, sf, "part"), "p_partkey", _BLOOM)


@query(f"SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT p_partkey FROM ({_HITS}) WHERE hit)")
def bf_4_semi_join(spark, sf):
    return bloom.semi_join(load(spark, sf, "part"), _bits(spark, sf), "p_partkey", _BLOOM).select("p_partkey", "p_name")


@query(f"SELECT floor({-_BLOOM.bits / _BLOOM.hashes!r} * ln(1 - count(*) / {_BLOOM.bits}.0) + 1e-9)::BIGINT AS estimate FROM ({_BITS})")
def bf_5_count(spark, sf):
    return bloom.estimated_count(_bits(spark, sf), _BLOOM)


_CK = 4096
_CK_MASK = cuckoo.buckets(_CK) - 1


def _place_sql(item: str) -> str:
    h = h60_sql(f"{item}::VARCHAR")
    fp = f"greatest(({h} >> 32) & 255, 1)"
    return f"least({h} & {_CK_MASK}, xor({h} & {_CK_MASK}, ({fp} * 1540483477) & {_CK_MASK})) AS b, {fp}::INT AS fp"


@query(f"SELECT b, fp, count(*)::BIGINT AS n FROM (SELECT {_place_sql('c_custkey')} FROM customer) GROUP BY b, fp")
def ck_2_table(spark, sf):
    return cuckoo.build(load(spark, sf, "customer"), "c_custkey", _CK)


@query(f"SELECT b, fp, count(*)::BIGINT AS n FROM (SELECT {_place_sql('o_custkey')} FROM (SELECT DISTINCT o_custkey FROM orders)) GROUP BY b, fp")
def ck_3_insert_unique(spark, sf):
    return cuckoo.insert_unique(load(spark, sf, "orders"), "o_custkey", _CK)


@query(f"""WITH t AS (SELECT DISTINCT {_place_sql('c_custkey')} FROM customer WHERE c_acctbal > 5000), p AS (SELECT DISTINCT o_custkey, {_place_sql('o_custkey')} FROM orders)
SELECT o_custkey, EXISTS (SELECT 1 FROM t WHERE t.b = p.b AND t.fp = p.fp) AS hit FROM p""")
def ck_4_contains(spark, sf):
    table = cuckoo.build(load(spark, sf, "customer").where("c_acctbal > 5000"), "c_custkey", _CK)
    return cuckoo.contains(table, load(spark, sf, "orders"), "o_custkey", _CK)


@query(f"""SELECT b, fp, n FROM (SELECT b, fp, sum(d)::BIGINT AS n FROM (
  SELECT {_place_sql('c_custkey')}, 1 AS d FROM customer UNION ALL SELECT {_place_sql('c_custkey')}, -1 AS d FROM customer WHERE c_acctbal < 0) GROUP BY b, fp) WHERE n > 0""")
def ck_5_delete(spark, sf):
    customers = load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    ops = customers.withColumn("d", F.lit(1)).unionByName(customers.where("c_acctbal < 0").withColumn("d", F.lit(-1)))
    return cuckoo.build(ops, "c_custkey", _CK, "d")


@query(f"SELECT count(*)::BIGINT AS count, count(*) / {(_CK_MASK + 1) * 4}.0 AS load_factor FROM customer")
def ck_6_load(spark, sf):
    return cuckoo.load(cuckoo.build(load(spark, sf, "customer"), "c_custkey", _CK), _CK)


@query("""SELECT l_returnflag, q, CASE q WHEN 0.5 THEN a WHEN 0.95 THEN b ELSE c END AS quantile FROM (
SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS a, quantile_disc(l_extendedprice, 0.95) AS b, quantile_disc(l_extendedprice, 0.99) AS c FROM lineitem GROUP BY l_returnflag),
(VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) v(q)""")
def td_3_quantile(spark, sf):
    return quantiles.quantile(load(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.95, 0.99], ["l_returnflag"])


@query("""WITH s AS (SELECT event_type, x, count(value) AS n, count(*) FILTER (WHERE value <= x) AS i, max(value) FILTER (WHERE value <= x) AS a, min(value) FILTER (WHERE value > x) AS b
FROM events, (VALUES (10.0::DOUBLE), (50.0::DOUBLE), (90.0::DOUBLE)) v(x) GROUP BY event_type, x)
SELECT event_type, x, round(CASE WHEN a IS NULL THEN 0.0 WHEN b IS NULL THEN 1.0 ELSE least((i + (x - a) / (b - a)) / n, 1.0) END, 9) AS cdf FROM s""")
def td_4_cdf(spark, sf):
    return quantiles.cdf(load(spark, sf, "events"), "value", [10.0, 50.0, 90.0], ["event_type"]).withColumn("cdf", F.round("cdf", 9))


@query("""SELECT l_returnflag, sum(l_quantity) AS weight, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean
FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag""")
def td_5_summary(spark, sf):
    return quantiles.summary(load(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]).withColumn("mean", F.round("mean", 4))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS interpolated, count(*)::BIGINT AS n FROM lineitem GROUP BY l_returnflag")
def td_6_merge(spark, sf):
    lines = load(spark, sf, "lineitem")
    parts = [quantiles.histogram(lines.where(F.col("l_linestatus") == s), "l_quantity", ["l_returnflag"]) for s in "OF"]
    return quantiles.histogram_quantile(quantiles.merge_histograms(*parts, keys=["l_returnflag"]), 0.9, ["l_returnflag"]).withColumn("interpolated", F.round("interpolated", 6))


@query()
def td_8_digest(spark, sf):
    return quantiles.digest_quantile(quantiles.digest(load(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]), [0.5, 0.95, 0.99], ["l_returnflag"])


@query()
def ss_1_bounded(spark, sf):
    return heavy_hitters.bounded_top(load(spark, sf, "events"), "user_id", 10, 1000)


@query()
def ss_1_sequential(spark, sf):
    return heavy_hitters.space_saving(load(spark, sf, "events"), "user_id", ["ts", "event_id"], 20, ["event_type"])


@query("""SELECT item, coalesce(cnt, 0) AS cnt FROM (SELECT DISTINCT c_custkey AS item FROM customer) LEFT JOIN (SELECT o_custkey AS item, count(*) AS cnt FROM orders GROUP BY 1) USING (item)""")
def ss_2_counts(spark, sf):
    counters = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("cnt"))
    return heavy_hitters.count_of(counters, load(spark, sf, "customer"), "c_custkey")


@query("SELECT user_id AS item, count(*) AS cnt FROM events GROUP BY 1 ORDER BY cnt DESC, item LIMIT 10")
def ss_3_top(spark, sf):
    return heavy_hitters.top(load(spark, sf, "events"), "user_id", 10)


_RATES = f"SELECT user_id AS item, sum(exp(-ln(2) / {DAY} * (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6)) AS rate FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1"


@query(f"SELECT item, round(rate, 6) AS rate FROM ({_RATES})")
def ss_6_rates(spark, sf):
    return heavy_hitters.rates(load(spark, sf, "events"), "user_id", "ts", NOW, DAY).withColumn("rate", F.round("rate", 6))


@query(f"SELECT item, round(coalesce(rate, 0), 6) AS rate FROM (SELECT DISTINCT c_custkey AS item FROM customer) LEFT JOIN ({_RATES}) USING (item)")
def ss_7_rate_of(spark, sf):
    rates = heavy_hitters.rates(load(spark, sf, "events"), "user_id", "ts", NOW, DAY)
    return heavy_hitters.rate_of(rates, load(spark, sf, "customer"), "c_custkey").withColumn("rate", F.round("rate", 6))


@query(f"SELECT item, round(rate, 6) AS rate FROM ({_RATES}) ORDER BY rate DESC, item LIMIT 10")
def ss_8_top_rates(spark, sf):
    return heavy_hitters.top_rates(load(spark, sf, "events"), "user_id", "ts", NOW, DAY, 10).withColumn("rate", F.round("rate", 6))
