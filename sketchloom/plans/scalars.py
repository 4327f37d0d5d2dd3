"""Queries of the column functions and of prefix and network lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses, entropy, names, numbers, semver, strings
from ..operators import networks, prefixes
from ..sources.tables import load
from .registry import query

_HOST = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"


@query("""SELECT page_id, regexp_matches(url, '^https://.*/en/.*$') AS a, regexp_matches(url, '^http.://[mw][^x].*$') AS b, url LIKE 'https://m.%' AS c, regexp_matches(url, '^.*[0-4].html$') AS d FROM pages""")
def str_1_glob(spark, sf):
    u = F.col("url")
    m = strings.glob_match
    return load(spark, sf, "pages").select("page_id", m(u, "https://*/en/*").alias("a"), m(u, "http?://[mw][!x]*").alias("b"), m(u, "https://m.*").alias("c"), m(u, "*[0-4]?html").alias("d"))


@query("""SELECT page_id, regexp_matches(path, '^/[^/]*/[0-9][^/]*$') AS a, regexp_matches(path, '^/e.*/.*$') AS b, regexp_matches(path, '^/[^/][^/]/[^/]*$') AS c
FROM (SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def str_3_segments(spark, sf):
    p = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    m = strings.glob_match_segments
    return load(spark, sf, "pages").select("page_id", m(p, "/*/[0-9]*").alias("a"), m(p, "/e**/**").alias("b"), m(p, "/??/*").alias("c"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, ((len(w) + 1) // 2)::INT), lambda i: array_to_string(w[i * 2 + 1:i * 2 + 2], ' ')), '|') AS parts FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def str_4_chunks(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.array_join(F.transform(strings.chunks(F.split("p_name", " "), 2), lambda c: F.array_join(c, " ")), "|").alias("parts"))


@query("SELECT n_nationkey, replace(replace(replace(n_name, 'A', 'b'), 'IN', '_'), 'T', 't') AS replaced, 'A=b,IN=_,T=t' AS sorted FROM nation")
def str_5_maps(spark, sf):
    m = F.create_map(*map(F.lit, ("T", "t", "A", "b", "IN", "_")))
    text = F.array_join(F.transform(F.map_entries(strings.sort_map(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return load(spark, sf, "nation").select("n_nationkey", strings.replace_map_column(F.col("n_name"), m).alias("replaced"), text.alias("sorted"))


@query("SELECT c_custkey, 'Dear ' || c_name || ', {{ missing }}: ' || c_mktsegment AS letter FROM customer")
def str_6_template(spark, sf):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return load(spark, sf, "customer").select("c_custkey", strings.simple_template(F.lit("Dear {{ name }}, {{ missing }}: {{segment}}"), m).alias("letter"))


@query("SELECT p_partkey, list_contains(string_split(p_type, ' '), 'STEEL') AS steel FROM part")
def str_7_contains(spark, sf):
    return load(spark, sf, "part").select("p_partkey", strings.slice_contains(F.split("p_type", " "), "STEEL").alias("steel"))


@query("SELECT n_nationkey, n_name AS cleaned FROM nation")
def str_8_clean(spark, sf):
    dirty = F.concat(F.lit("\u0001\t"), F.col("n_name"), F.lit("​\n"))
    return load(spark, sf, "nation").select("n_nationkey", strings.string_clean(dirty).alias("cleaned"))


@query("SELECT n_nationkey, 'max_items_of_' || n_nationkey AS snake FROM nation")
def cfg_5_camel_to_snake(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", strings.camel_to_snake(F.concat(F.lit("maxItemsOf_"), F.col("n_nationkey").cast("string"))).alias("snake"))


@query("""WITH b AS (SELECT doc_id, substr(hex(encode(text)), 2 * i - 1, 2) AS byte FROM documents, LATERAL (SELECT unnest(range(1, octet_length(encode(text)) + 1)) AS i)),
c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t, sum(n * log2(n)) AS s, max(n) AS m, count(*) AS u FROM c GROUP BY doc_id)
SELECT doc_id, round(log2(t) - s / t, 6) AS shannon, round(CASE WHEN u > 1 THEN (log2(t) - s / t) / log2(u) ELSE 0 END, 6) AS normalized, round(-log2(m / t), 6) AS min_entropy, round(CASE WHEN u > 1 THEN -log2(m / t) / log2(u) ELSE 0 END, 6) AS min_normalized,
CASE WHEN u > 1 THEN (log2(t) - s / t) / log2(u) ELSE 0 END >= 0.7 AS random, CASE WHEN u > 1 THEN -log2(m / t) / log2(u) ELSE 0 END >= 0.5 AS secure FROM t""")
def ent_1_entropy(spark, sf):
    e = entropy.entropy(load(spark, sf, "documents"), "doc_id", "text")
    return e.select("doc_id", *(F.round(c, 6).alias(c) for c in ("shannon", "normalized", "min_entropy", "min_normalized")), entropy.is_random(F.col("normalized"), 0.7).alias("random"), entropy.is_secure(F.col("min_normalized"), 0.5).alias("secure"))


@query("SELECT c_custkey, round(c_acctbal * 10.0::DOUBLE, 0) / 10.0::DOUBLE AS near, ceil(c_acctbal * 10.0::DOUBLE) / 10.0::DOUBLE AS up, floor(c_acctbal * 10.0::DOUBLE) / 10.0::DOUBLE AS down FROM customer")
def num_1_round(spark, sf):
    v = F.col("c_acctbal")
    return load(spark, sf, "customer").select("c_custkey", numbers.round64(v, 1).alias("near"), numbers.round64_up(v, 1).alias("up"), numbers.round64_down(v, 1).alias("down"))


@query()
def num_2_random(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", numbers.rand_int(5, 10, 1).alias("r"))


@query()
def id_1_uxid(spark, sf):
    return load(spark, sf, "events").select("event_id", numbers.uxid(F.col("ts"), F.col("event_id")).alias("uxid"))


@query(f"SELECT page_id, host, CASE WHEN contains(host, '.') THEN substr(host, instr(host, '.') + 1) END AS domain, host || '.' AS zone FROM (SELECT page_id, lower({_HOST}) AS host FROM pages)")
def dns_1_domain(spark, sf):
    h = load(spark, sf, "pages").select("page_id", names.host_of(F.col("url")).alias("host"))
    return h.select("page_id", "host", names.domain_from_hostname(F.col("host")).alias("domain"), names.normalize_zone(F.col("host")).alias("zone"))


@query(f"SELECT page_id, array_to_string(p[i:], '.') AS guess FROM (SELECT page_id, string_split(lower({_HOST}), '.') AS p FROM pages), range(1, 50) r(i) WHERE i <= len(p)")
def dns_2_guesses(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.explode(names.domain_name_guesses(names.host_of(F.col("url")))).alias("guess"))


_VERSION = "concat(l_partkey % 5, '.', l_suppkey % 10, '.', l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-rc.' || (l_partkey % 12) WHEN 2 THEN '-alpha' ELSE '+b7' END)"
_PARTS = "SELECT *, (l_partkey % 5) AS a, (l_suppkey % 10) AS b, l_linenumber AS c, l_orderkey % 4 AS k, l_partkey % 12 AS r FROM lineitem"


def _versions(spark, sf):
    mod = lambda c, n: F.pmod(c, F.lit(n)).cast("string")
    tail = F.when(F.pmod("l_orderkey", F.lit(4)) == 0, "").when(F.pmod("l_orderkey", F.lit(4)) == 1, F.concat(F.lit("-rc."), mod("l_partkey", 12))).when(F.pmod("l_orderkey", F.lit(4)) == 2, "-alpha").otherwise("+b7")
    text = F.concat(F.concat_ws(".", mod("l_partkey", 5), mod("l_suppkey", 10), "l_linenumber"), tail)
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("version"))


@query(f"""SELECT l_orderkey, l_linenumber, {_VERSION} AS version, a::BIGINT AS major, b::BIGINT AS minor, c::BIGINT AS patch, CASE k WHEN 1 THEN 'rc.' || r WHEN 2 THEN 'alpha' END AS prerelease, CASE k WHEN 3 THEN 'b7' END AS build FROM ({_PARTS})""")
def sv_1_parse(spark, sf):
    v = _versions(spark, sf).withColumn("v", semver.parse(F.col("version")))
    return v.select("l_orderkey", "l_linenumber", semver.to_text(F.col("v")).alias("version"), *(F.col(f"v.{c}").cast("long").alias(c) for c in ("major", "minor", "patch")), "v.prerelease", "v.build")


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS valid, CASE n_nationkey % 3 WHEN 0 THEN concat(n_nationkey, '.1.0') END AS text FROM nation")
def sv_2_valid(spark, sf):
    raw = F.concat(F.when(F.pmod("n_nationkey", F.lit(3)) == 1, "x").otherwise("v"), F.col("n_nationkey"), F.lit(".1"), F.when(F.pmod("n_nationkey", F.lit(3)) == 2, ".0-01").otherwise(""))
    return load(spark, sf, "nation").select("n_nationkey", semver.is_valid(raw).alias("valid"), semver.to_text(semver.parse(raw)).alias("text"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN (a, b, c) < (2, 5, 3) THEN -1 WHEN (a, b, c) > (2, 5, 3) THEN 1 WHEN k IN (0, 3) THEN 1 WHEN k = 2 THEN -1 WHEN r < 5 THEN -1 WHEN r > 5 THEN 1 ELSE 0 END AS cmp FROM ({_PARTS})""")
def sv_3_compare(spark, sf):
    v = _versions(spark, sf)
    return v.select("l_orderkey", "l_linenumber", semver.compare(semver.parse(F.col("version")), semver.parse(F.lit("2.5.3-rc.5"))).alias("cmp"))


@query(f"""SELECT DISTINCT version, dense_rank() OVER (ORDER BY a, b, c, k IN (0, 3), CASE WHEN k = 1 THEN 1 ELSE 0 END, CASE WHEN k = 1 THEN r END NULLS FIRST)::INT AS place FROM (SELECT *, {_VERSION} AS version FROM ({_PARTS}))""")
def sv_4_sort(spark, sf):
    from pyspark.sql import Window

    distinct = _versions(spark, sf).select("version").distinct()  # a few hundred texts
    return distinct.select("version", F.dense_rank().over(Window.orderBy(semver.key(semver.parse(F.col("version"))))).alias("place"))


@query(f"SELECT l_orderkey, l_linenumber, concat(a + 1, '.0.0') AS major, concat(a, '.', b + 1, '.0') AS minor, concat(a, '.', b, '.', c + 1) AS patch FROM ({_PARTS})")
def sv_5_increment(spark, sf):
    v = semver.parse(F.col("version"))
    return _versions(spark, sf).select("l_orderkey", "l_linenumber", *(semver.to_text(semver.increment(v, p)).alias(p) for p in ("major", "minor", "patch")))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN a <> 2 THEN 'major' WHEN b <> 5 THEN 'minor' WHEN c <> 3 THEN 'patch' WHEN k IN (1, 2) THEN 'prerelease' ELSE '' END AS d FROM ({_PARTS})")
def sv_6_diff(spark, sf):
    return _versions(spark, sf).select("l_orderkey", "l_linenumber", semver.diff(semver.parse(F.col("version")), semver.parse(F.lit("v2.5.3"))).alias("d"))


@query(f"""SELECT l_orderkey, l_linenumber,
  (a, b, c, pre) >= (1, 2, 0, 1) AND (a, b, c, pre) < (1, 3, 0, 1) AS tilde,
  (a, b, c, pre) >= (0, 2, 3, 1) AND (a, b, c, pre) < (0, 3, 0, 1) AS caret,
  ((a, b, c, pre) >= (1, 0, 0, 1) AND (a, b, c, pre) < (2, 0, 0, 1)) OR ((a, b, c, pre) > (3, 1, 0, 1) AND NOT (a = 3 AND b = 4 AND c = 5 AND pre = 1)) AS either,
  (a, b, c, pre) >= (1, 0, 0, 1) AND (a, b, c, pre) < (2, 4, 0, 1) AS hyphen
FROM (SELECT *, CASE WHEN k IN (0, 3) THEN 1 ELSE 0 END AS pre FROM ({_PARTS}))""")
def sv_7_constraints(spark, sf):
    v = _versions(spark, sf).withColumn("v", semver.parse(F.col("version")))
    ok = lambda c: semver.satisfies(F.col("v"), c)
    return v.select("l_orderkey", "l_linenumber", ok("~1.2").alias("tilde"), ok("^0.2.3").alias("caret"), ok("1.x || >3.1, !=3.4.5").alias("either"), ok("1 - 2.3").alias("hyphen"))


_TABLE = "SELECT DISTINCT substr(p_name, 1, 4) AS key FROM part UNION SELECT DISTINCT substr(p_name, 1, 6) FROM part WHERE p_size > 25"


def _prefix_table(spark, sf):
    part = load(spark, sf, "part")
    keys = part.select(F.substring("p_name", 1, 4).alias("key")).union(part.where("p_size > 25").select(F.substring("p_name", 1, 6))).distinct()
    return keys.withColumn("value", F.length("key"))


@query(f"SELECT key, CASE WHEN key IN (SELECT substr(p_name, 1, 4) FROM part WHERE p_size < 10) THEN 0 ELSE length(key) END::INT AS value FROM ({_TABLE})")
def rt_1_upsert(spark, sf):
    changed = load(spark, sf, "part").where("p_size < 10").select(F.substring("p_name", 1, 4).alias("key"), F.lit(0).alias("value")).distinct()
    return prefixes.upsert(_prefix_table(spark, sf), changed)


@query(f"SELECT count(*) AS n, min(key) AS first, max(key) AS last FROM ({_TABLE})")
def rt_7_keys(spark, sf):
    return _prefix_table(spark, sf).agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))


@query(f"SELECT p_name, CASE WHEN key IS NOT NULL THEN length(key)::INT END AS value FROM (SELECT DISTINCT substr(p_name, 1, 6) AS p_name FROM part) LEFT JOIN ({_TABLE}) ON key = p_name")
def rt_2_get(spark, sf):
    probes = load(spark, sf, "part").select(F.substring("p_name", 1, 6).alias("p_name"))
    return prefixes.get(_prefix_table(spark, sf), probes, "p_name")


@query(f"SELECT key, length(key)::INT AS value FROM ({_TABLE}) WHERE NOT starts_with(key, 'a') AND key NOT IN (SELECT substr(p_name, 1, 4) FROM part WHERE p_size < 3)")
def rt_3_delete(spark, sf):
    gone = load(spark, sf, "part").where("p_size < 3").select(F.substring("p_name", 1, 4).alias("k"))
    return prefixes.delete(prefixes.delete_prefix(_prefix_table(spark, sf), "a"), gone).select("key", "value")


def _match_sql(best: str) -> str:
    return f"SELECT p_name, {best}(key, length(key)) AS key, {best[:3]}(length(key))::INT AS value FROM (SELECT DISTINCT p_name FROM part) JOIN ({_TABLE}) ON starts_with(p_name, key) GROUP BY p_name"


@query(_match_sql("max_by"))
def rt_4_longest_prefix(spark, sf):
    return prefixes.longest_prefix(_prefix_table(spark, sf), load(spark, sf, "part"), "p_name")


@query(_match_sql("min_by"))
def rt_5_shortest_prefix(spark, sf):
    return prefixes.longest_prefix(_prefix_table(spark, sf), load(spark, sf, "part"), "p_name", shortest=True)


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'part')")
def rt_6_prefix_search(spark, sf):
    return prefixes.prefix_search(load(spark, sf, "part").select("p_partkey", "p_name"), "part", "p_name")


@query(f"SELECT key, CASE WHEN length(key) = 6 THEN -1 ELSE 4 END AS value FROM ({_TABLE})")
def rt_8_merge(spark, sf):
    table = _prefix_table(spark, sf)
    newer = table.where("value = 6").select("key", F.lit(-1).alias("value"))
    return prefixes.upsert(table, newer)


_IP = "(10 * 16777216 + (l_partkey % 256) * 65536 + (l_suppkey % 256) * 256 + l_orderkey % 256)"
_IP_TEXT = "concat('10.', l_partkey % 256, '.', l_suppkey % 256, '.', l_orderkey % 256)"


def _addresses(spark, sf):
    mod = lambda c: F.pmod(c, F.lit(256)).cast("string")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(".", F.lit("10"), mod("l_partkey"), mod("l_suppkey"), mod("l_orderkey")).alias("ip"))


def _networks(spark, sf):
    nation = load(spark, sf, "nation").select(F.concat(F.lit("10."), F.col("n_nationkey") * 4, F.lit(".0.0/14")).alias("cidr"))
    return nation.union(spark.createDataFrame([("10.200.7.0/24",), ("bad",), ("10.0.0.0/15",)], "cidr string"))


_NET_IN = f"(({_IP} >> 24) = 10 AND (({_IP} >> 16) & 255) < 100) OR ({_IP} >> 8) = ((10 * 256 + 200) * 256 + 7)"


@query(f"SELECT DISTINCT {_IP_TEXT} AS ip, {_NET_IN} AS hit FROM lineitem")
def net_1_contains(spark, sf):
    return networks.contains(_addresses(spark, sf), _networks(spark, sf), "ip", "cidr")


@query(f"SELECT l_orderkey, l_linenumber, ({_IP} >> 17) = (10 * 128 + 3) AS hit FROM lineitem")
def net_2_matcher(spark, sf):
    holds = networks.matcher(["10.6.0.0/16", "10.7.0.0/16", "2001:db8::/32"])
    return _addresses(spark, sf).select("l_orderkey", "l_linenumber", holds("ip").alias("hit"))


@query("SELECT lo::BIGINT AS lo, prefix::INT AS prefix, cidr FROM (VALUES (167772160, 10, '10.0.0.0/10'), (171966464, 11, '10.64.0.0/11'), (174063616, 14, '10.96.0.0/14'), (180881152, 24, '10.200.7.0/24')) v(lo, prefix, cidr)")
def net_3_merge(spark, sf):
    return networks.merge(_networks(spark, sf).where("cidr <> 'bad'"), "cidr")


@query("""SELECT '10.' || n_nationkey * 4 || '.0.0/14' AS cidr, '10.' || (n_nationkey * 4 + i // 16) || '.' || ((i % 16) * 16) || '.0/20' AS subnet, 167772160 + n_nationkey * 262144 + i * 4096 AS lo FROM nation, range(0, 64) r(i)""")
def net_4_split(spark, sf):
    nation = load(spark, sf, "nation").select(F.concat(F.lit("10."), F.col("n_nationkey") * 4, F.lit(".0.0/14")).alias("cidr"))
    return networks.split(nation, "cidr", 20)


def _both_families(spark, sf):
    """An address of each line: IPv4, IPv6 or IPv4-mapped."""
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.pmod("l_partkey", F.lit(256)))), F.lit("::"), F.lower(F.hex(F.pmod("l_orderkey", F.lit(256)) + 1)))
    kind = F.pmod("l_linenumber", F.lit(3))
    four = F.concat_ws(".", F.lit("10"), *(F.pmod(c, F.lit(256)).cast("string") for c in ("l_partkey", "l_suppkey", "l_orderkey")))
    return load(spark, sf, "lineitem").select(F.when(kind == 0, six).when(kind == 1, four).otherwise(F.concat(F.lit("::ffff:"), four)).alias("ip"))


_ANY_NETS = ["2001:db8:40::/42", "2001:db8::7/128", "10.64.0.0/10", "bad"]


@query("""SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN concat('2001:db8:', lower(to_hex(l_partkey % 256)), '::', lower(to_hex(l_orderkey % 256 + 1)))
WHEN 1 THEN concat('10.', l_partkey % 256, '.', l_suppkey % 256, '.', l_orderkey % 256) ELSE concat('::ffff:10.', l_partkey % 256, '.', l_suppkey % 256, '.', l_orderkey % 256) END AS ip,
CASE l_linenumber % 3 WHEN 0 THEN l_partkey % 256 BETWEEN 64 AND 127 OR (l_partkey % 256 = 0 AND l_orderkey % 256 = 6) ELSE l_partkey % 256 BETWEEN 64 AND 127 END AS hit FROM lineitem""")
def net_1_contains_any(spark, sf):
    return networks.contains_any(_both_families(spark, sf), spark.createDataFrame([(n,) for n in _ANY_NETS], "cidr string"), "ip", "cidr")


@query("SELECT unnest(['10.0.0.0/10', '10.64.0.0/11', '10.96.0.0/14', '2001:db8::/36', '2001:db8:1000::/37', '2001:db8:1800::/40']) AS cidr")
def net_3_merge_any(spark, sf):
    """Twenty-five neighbouring networks of each family."""
    nation = load(spark, sf, "nation")
    four = nation.select(F.concat(F.lit("10."), F.col("n_nationkey") * 4, F.lit(".0.0/14")).alias("cidr"))
    six = nation.select(F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("n_nationkey") * 256)), F.lit("::/40")).alias("cidr"))
    return networks.merge_any(four.unionByName(six), "cidr")


@query("SELECT concat('2001:db8:', lower(to_hex(n_nationkey + 1)), '::/48') AS cidr, CASE i WHEN 0 THEN concat('2001:db8:', lower(to_hex(n_nationkey + 1)), '::/52') ELSE concat('2001:db8:', lower(to_hex(n_nationkey + 1)), ':', lower(to_hex(i * 4096)), '::/52') END AS subnet FROM nation, range(0, 16) r(i)")
def net_4_split_ipv6(spark, sf):
    six = load(spark, sf, "nation").select(F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("n_nationkey") + 1)), F.lit("::/48")).alias("cidr"))
    return networks.split_ipv6(six, "cidr", 52)


@query(f"SELECT l_orderkey, l_linenumber, concat('10.', l_partkey % 256, '.', (l_suppkey % 256) - (l_suppkey % 256) % 16, '.0') AS net FROM lineitem")
def net_5_strip(spark, sf):
    number = addresses.ipv4_number(F.col("ip"))
    return _addresses(spark, sf).select("l_orderkey", "l_linenumber", addresses.ipv4_text(addresses.strip_ipv4(number, 20)).alias("net"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 5 THEN 'TCP4' END AS family, CASE WHEN l_linenumber < 5 THEN {_IP_TEXT} END AS src, CASE WHEN l_linenumber < 5 THEN l_orderkey % 65536 END::INT AS src_port FROM lineitem")
def net_6_proxy_v1(spark, sf):
    line = F.concat(F.lit("PROXY TCP4 "), F.col("ip"), F.lit(" 10.0.0.1 "), F.pmod("l_orderkey", F.lit(65536)), F.when(F.col("l_linenumber") < 5, " 443\r\n").otherwise(" 70000\r\n"))
    return _addresses(spark, sf).withColumn("h", addresses.proxy_v1(line)).select("l_orderkey", "l_linenumber", "h.family", "h.src", "h.src_port")


@query(f"SELECT l_orderkey, l_linenumber, 'TCP4' AS family, {_IP_TEXT} AS src, '10.0.0.1' AS dst, (l_orderkey % 65536)::INT AS src_port, 443 AS dst_port FROM lineitem")
def net_7_proxy_v2(spark, sf):
    port = F.substring(F.hex(F.pmod("l_orderkey", F.lit(65536)) + 65536), 2, 4)
    body = F.concat(F.lit("0D0A0D0A000D0A515549540A2111000C0A"), *(F.substring(F.hex(F.pmod(c, F.lit(256)) + 256), 2, 2) for c in ("l_partkey", "l_suppkey", "l_orderkey")), F.lit("0A000001"), port, F.lit("01BB"))
    h = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", addresses.proxy_v2(F.unhex(body)).alias("h"))
    return h.select("l_orderkey", "l_linenumber", "h.family", "h.src", "h.dst", "h.src_port", "h.dst_port")
