"""Queries of ordered state: smoothing, rate limits, chains, chunks, caches, secrets."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.hashing import digest, digest32, digest64
from ..operators import cachesim, chunking, decay, markov, ratelimit, secrets
from ..sources.tables import load
from .registry import query
from .sketches import DAY, NOW


@query("""WITH t AS (SELECT user_id, floor(epoch_us(ts) / 3600000000)::BIGINT AS tick, count(*) AS n FROM events GROUP BY 1, 2),
every AS (SELECT user_id, unnest(range(min(tick), max(tick) + 1)) AS tick FROM t GROUP BY user_id)
SELECT user_id, tick, coalesce(n, 0) AS n FROM every LEFT JOIN t USING (user_id, tick)""")
def ew_3_ticks(spark, sf):
    return decay.ticks(load(spark, sf, "events"), ["user_id"], "ts", 3600)


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.1 * x + 0.9 * a), 6) AS ewma FROM events GROUP BY user_id")
def ew_4_ewma(spark, sf):
    return decay.ewma_of_values(load(spark, sf, "events"), ["user_id"], "value", ["ts", "event_id"], 0.1).withColumn("ewma", F.round("ewma", 6))


_ALPHAS = {"m1": 0.5, "m5": 0.2, "m15": 0.05}


@query(f"""WITH t AS (SELECT user_id, floor(epoch_us(ts) / 3600000000)::BIGINT AS tick, count(*) AS n FROM events GROUP BY 1, 2),
every AS (SELECT user_id, unnest(range(min(tick), max(tick) + 1)) AS tick FROM t GROUP BY user_id),
s AS (SELECT user_id, list(coalesce(n, 0) / 3600.0::DOUBLE ORDER BY tick) AS v, max(tick) AS last_tick FROM every LEFT JOIN t USING (user_id, tick) GROUP BY user_id)
SELECT user_id, last_tick, {", ".join(f"round(list_reduce(v, lambda a, x: {a}::DOUBLE * x + (1 - {a}::DOUBLE) * a), 9) AS {k}" for k, a in _ALPHAS.items())} FROM s""")
def ew_6_moving_averages(spark, sf):
    out = decay.moving_averages(load(spark, sf, "events"), ["user_id"], "ts", 3600, _ALPHAS)
    return out.withColumns({k: F.round(k, 9) for k in _ALPHAS})


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, k, value AS ewma FROM o WHERE k = 1 UNION ALL SELECT o.event_id, o.user_id, o.k, 0.1 * o.value + 0.9 * r.ewma FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT event_id, round(ewma, 6) AS ewma FROM r""")
def ew_7_running(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return decay.running_ewma(events, ["user_id"], "value", ["ts", "event_id"], 0.1).select("event_id", F.round("ewma", 6).alias("ewma"))


@query(f"SELECT event_type, round(sum(value * exp(-ln(2) / {DAY} * (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6)), 4) AS rate FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1")
def ew_8_rate(spark, sf):
    return decay.decayed_sum(load(spark, sf, "events"), ["event_type"], "ts", NOW, DAY, "value").withColumn("rate", F.round("rate", 4))


@query(f"""SELECT event_type, round(sum(n * exp(-ln(2) / {DAY} * (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 1e6)), 6) AS rate FROM (
SELECT event_type, ts, 1.0 AS n FROM events WHERE ts > TIMESTAMP '2024-01-15' UNION ALL SELECT DISTINCT event_type, TIMESTAMP '2024-01-15', 100.0 FROM events) WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1""")
def ew_9_seeded(spark, sf):
    events = load(spark, sf, "events")
    seeds = events.select("event_type").distinct().select("event_type", F.lit("2024-01-15").cast("timestamp").alias("ts"), F.lit(100.0).alias("rate"))
    return decay.seeded_rate(events, ["event_type"], "ts", NOW, DAY, seeds).withColumn("rate", F.round("rate", 6))


@query("""SELECT b.event_id, round(sum(exp(-ln(2) / 3600 * (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6)), 6) AS rate
FROM events b JOIN events a ON a.user_id = b.user_id AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id <= b.event_id)) GROUP BY b.event_id""")
def ew_10_running_rate(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", "ts")
    return decay.running_rate(events, ["user_id"], "ts", "event_id", 3600.0).select("event_id", F.round("rate", 6).alias("rate"))


_FOLD = """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, ts, k, 1::BIGINT AS count, ts + INTERVAL 1 DAY AS window_end FROM o WHERE k = 1
UNION ALL SELECT o.event_id, o.user_id, o.ts, o.k, CASE WHEN o.ts > r.window_end THEN 1 ELSE r.count + 1 END, CASE WHEN o.ts > r.window_end THEN o.ts + INTERVAL 1 DAY ELSE r.window_end END
FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)"""


def _replayed(spark, sf):
    return ratelimit.replay(load(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, DAY)


@query(_FOLD + " SELECT event_id, count <= 3 AS allowed, count FROM r")
def fw_2_allow(spark, sf):
    return _replayed(spark, sf).select("event_id", "allowed", "count")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, (event_id % 4)::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_id % 4 > 0),
r AS (SELECT event_id, user_id, k, n AS count, ts + INTERVAL 1 DAY AS e FROM o WHERE k = 1
UNION ALL SELECT o.event_id, o.user_id, o.k, CASE WHEN o.ts > r.e THEN o.n ELSE r.count + o.n END, CASE WHEN o.ts > r.e THEN o.ts + INTERVAL 1 DAY ELSE r.e END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT event_id, count FROM r""")
def fw_3_add(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", "ts", F.pmod("event_id", F.lit(4)).alias("n"))
    return ratelimit.replay(events, "user_id", "ts", "event_id", 0, DAY, "n").where("n > 0").select("event_id", "count")


@query(_FOLD + """, last AS (SELECT user_id, max_by({'c': count, 'e': window_end}, k) AS x FROM r WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY user_id)
SELECT user_id, CASE WHEN TIMESTAMP '2024-01-20' > x.e THEN 0 ELSE x.c END AS count, TIMESTAMP '2024-01-20' <= x.e AND x.c > 3 AS locked FROM last""")
def fw_4_state(spark, sf):
    return ratelimit.state_at(_replayed(spark, sf), "user_id", "ts", "event_id", "2024-01-20").drop("expiry")


@query()
def fw_6_bounded(spark, sf):
    return ratelimit.replay_bounded(load(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, DAY, 50)


_TOKENS = "SELECT list_concat(list_concat(['^', '^'], list_filter(string_split(r_name || ' ' || n_name, ' '), lambda x: x <> '')), ['$', '$']) AS t FROM nation JOIN region ON n_regionkey = r_regionkey"


def _tokens(spark, sf):
    both = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", F.filter(F.split(F.concat_ws(" ", "r_name", "n_name"), " "), lambda x: x != "").alias("tokens"))


@query("SELECT n_nationkey, t[i:i + 1] AS current, t[i + 2] AS next FROM (SELECT n_nationkey, string_split(n_name, '') AS t FROM nation), range(1, 100) r(i) WHERE i <= len(t) - 2")
def mk_1_pairs(spark, sf):
    rows = load(spark, sf, "nation").select("n_nationkey", F.explode(markov.pairs(markov.characters(F.col("n_name")), 2)).alias("p"))
    return rows.select("n_nationkey", "p.current", "p.next")


@query(f"SELECT t[i:i + 1] AS current, t[i + 2] AS next, count(*) AS freq FROM ({_TOKENS}), range(1, 100) r(i) WHERE i <= len(t) - 2 GROUP BY 1, 2")
def mk_2_chain(spark, sf):
    return markov.chain(_tokens(spark, sf), "tokens", 2)


_CHARS = "SELECT list_concat(list_concat(['^'], string_split(c_name, '')), ['$']) AS t FROM customer"


@query(f"SELECT [t[i]] AS current, t[i + 1] AS next, count(*) AS freq FROM ({_CHARS}), range(1, 200) r(i) WHERE i <= len(t) - 1 GROUP BY 1, 2")
def mk_3_characters(spark, sf):
    return markov.chain(load(spark, sf, "customer").select(markov.characters(F.col("c_name")).alias("t")), "t", 1)


@query("""WITH w AS (SELECT list_concat(list_concat(['^'], list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), ['$']) AS t FROM documents),
e AS (SELECT c AS current, n AS next, count(*) AS freq FROM (SELECT unnest(t[1:len(t) - 1]) AS c, unnest(t[2:]) AS n FROM w) GROUP BY 1, 2)
SELECT [current] AS current, next, freq, round(freq / sum(freq) OVER (PARTITION BY current), 9) AS p FROM e""")
def mk_4_probability(spark, sf):
    words = load(spark, sf, "documents").select(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "").alias("t"))
    return markov.chain_probabilities(words, "t", 1).withColumn("p", F.round("p", 9))


@query()
def mk_5_generate(spark, sf):
    edges = markov.chain(load(spark, sf, "customer").select(markov.characters(F.col("c_name")).alias("t")), "t", 2)
    starts = spark.range(20).select(F.col("id").alias("state_id"), F.array(F.lit("^"), F.lit("^")).alias("current"))
    return markov.generate(edges, starts, 2, 6, seed=1)


_SIZES = chunking.Chunking(64, 256, 1024, 2)


@query()
def cdc_2_chunks(spark, sf):
    return chunking.chunk(load(spark, sf, "documents"), "text", ["doc_id"], _SIZES)


@query("SELECT doc_id, sha256(text) AS h, substr(sha256(text), 1, 64) AS h32, rpad(sha256(text), 128, '0') AS h64 FROM documents")
def cdc_7_digest(spark, sf):
    return load(spark, sf, "documents").select("doc_id", digest(F.col("text")).alias("h"), digest32(F.col("text")).alias("h32"), digest64(F.col("text")).alias("h64"))


@query("SELECT sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) FILTER (WHERE octet_length(encode(text)) > 0) AS documents, true AS gapless FROM documents")
def cdc_6_coverage(spark, sf):
    """Chunks of a document are contiguous and cover it."""
    chunks = chunking.chunk(load(spark, sf, "documents"), "text", ["doc_id"], _SIZES)
    each = chunks.groupBy("doc_id").agg(F.sum("length").alias("n"), (F.sum("length") == F.max(F.col("offset") + F.col("length"))).alias("ok"))
    return each.agg(F.sum("n").alias("bytes"), F.count("*").alias("documents"), F.bool_and("ok").alias("gapless"))


@query()
def cdc_8_dedup(spark, sf):
    return chunking.duplicates(chunking.chunk(load(spark, sf, "pages"), "html", ["page_id"], _SIZES))


@query("SELECT c_custkey, c_name AS secret, true AS verified FROM customer")
def sh_1_round_trip(spark, sf):
    shares = secrets.split_table(load(spark, sf, "customer"), "c_custkey", "c_name", 3, 5, seed=1)
    return secrets.combine_table(shares, "c_custkey").select("c_custkey", F.col("secret").cast("string").alias("secret"), "verified")


@query()
def sh_1_shares(spark, sf):
    return secrets.split_table(load(spark, sf, "supplier"), "s_suppkey", "s_name", 2, 3, seed=2)


@query("SELECT s_suppkey, s_name || ' ' || repeat(s_name, 3) AS data FROM supplier")
def sh_5_chunked(spark, sf):
    suppliers = load(spark, sf, "supplier").select("s_suppkey", F.concat_ws(" ", "s_name", F.repeat("s_name", 3)).alias("d"))
    shares = secrets.split_bytes_table(suppliers, "s_suppkey", "d", 2, 4, seed=3).where("x <> 2")
    return secrets.combine_bytes_table(shares, "s_suppkey").select("s_suppkey", F.col("data").cast("string").alias("data"))


@query("SELECT c_custkey, c_name AS data FROM customer")
def sh_6_gf256(spark, sf):
    shares = secrets.split_gf256_table(load(spark, sf, "customer"), "c_custkey", "c_name", 3, 4, seed=4)
    return secrets.combine_gf256_table(shares, "c_custkey").select("c_custkey", F.col("data").cast("string").alias("data"))


@query()
def arc_2_replay(spark, sf):
    events = load(spark, sf, "events").select("event_id", "event_type", "user_id", "ts")
    return cachesim.replay(events, "event_type", "user_id", ["ts", "event_id"], 20).select("event_id", "hit", "target", "resident", "evicted")


