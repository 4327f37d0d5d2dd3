"""Sets of networks: matching, merging and splitting.  IPv4 in the JVM, IPv6 in Arrow batches."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.addresses import ipv4_network, ipv4_number, ipv4_text


class BadNetwork(ValueError):
    pass


def contains(addresses: DataFrame, networks: DataFrame, ip: str, cidr: str) -> DataFrame:
    """(ip, hit) for each distinct IPv4 address: whether any network holds it; bad networks are skipped.

    One equi-join: addresses are masked to each prefix length that occurs, at most 33.
    """
    nets = networks.select(ipv4_network(F.col(cidr)).alias("n")).where("n is not null").select("n.lo", "n.prefix").distinct()
    lengths = [r["prefix"] for r in nets.select("prefix").distinct().collect()]
    asked = addresses.select(ip).where(F.col(ip).isNotNull()).distinct().withColumn("_x", ipv4_number(F.col(ip)))
    masked = F.array(*(F.struct((F.col("_x") - F.pmod(F.col("_x"), F.lit(1 << (32 - n)))).alias("lo"), F.lit(n).alias("prefix")) for n in lengths))
    if not lengths:
        return asked.select(ip, F.lit(False).alias("hit"))
    hits = asked.select(ip, F.explode(masked).alias("m")).select(ip, "m.lo", "m.prefix").join(nets, ["lo", "prefix"], "left_semi").select(ip).distinct()
    return asked.join(hits.withColumn("_h", F.lit(True)), ip, "left").select(ip, F.coalesce("_h", F.lit(False)).alias("hit"))


def matcher(networks: list[str]):
    """A function of an address column: whether a few fixed networks of either family hold it.

    Raises BadNetwork at once if one is malformed; IPv4-mapped addresses count as IPv4.
    """
    nets = []
    for x in networks:
        try:
            nets.append(ipaddress.ip_network(x, strict=False))
        except ValueError as e:
            raise BadNetwork(x) from e
    spans = {v: [(int(n.network_address), int(n.broadcast_address)) for n in ipaddress.collapse_addresses(x for x in nets if x.version == v)] for v in (4, 6)}

    @F.pandas_udf("boolean")
    def holds(ip: pd.Series) -> pd.Series:
        from bisect import bisect

        starts = {v: [a for a, _ in s] for v, s in spans.items()}

        def one(text):
            try:
                x = ipaddress.ip_address(text)
            except ValueError:
                return False
            if x.version == 6 and x.ipv4_mapped:
                x = x.ipv4_mapped
            k = bisect(starts[x.version], int(x)) - 1
            return k >= 0 and int(x) <= spans[x.version][k][1]

        return ip.map(one)

    return holds


def merge(networks: DataFrame, cidr: str, slices: int = 256) -> DataFrame:
    """(lo, prefix, cidr): the fewest IPv4 networks that cover the same addresses.

    Overlapping and adjacent ranges become islands (within slices of the address space, so no
    task sees all), islands are cut into aligned blocks, and blocks that meet at slice borders
    are merged again.
    """
    parsed = networks.select(ipv4_network(F.col(cidr)).alias("n"))
    if not parsed.where("n is null").limit(1).isEmpty():
        raise BadNetwork("a network is malformed")
    size = (1 << 32) // slices
    ranges = parsed.select("n.lo", "n.hi").distinct()
    cut = ranges.select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / size).cast("long"), F.floor(F.col("hi") / size).cast("long"))).alias("slice"))
    cut = cut.select("slice", F.greatest("lo", F.col("slice") * size).alias("lo"), F.least("hi", (F.col("slice") + 1) * size - 1).alias("hi"))
    islands = _islands(cut, "slice")
    # at most one island a slice touches each border: the rest are done
    whole = _islands(islands.select(F.lit(0).alias("slice"), "lo", "hi").where((F.pmod("lo", F.lit(size)) == 0) | (F.pmod(F.col("hi") + 1, F.lit(size)) == 0)), "slice")
    inner = islands.where((F.pmod("lo", F.lit(size)) != 0) & (F.pmod(F.col("hi") + 1, F.lit(size)) != 0))
    return blocks(inner.select("lo", "hi").unionByName(whole.select("lo", "hi")))


def _islands(ranges: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy(part).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
    named = starts.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(part, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def blocks(ranges: DataFrame) -> DataFrame:
    """Aligned blocks of disjoint ranges: at most 32 going up and 32 going down for each range."""
    bits = F.sequence(F.lit(0), F.lit(31))
    lo, end = F.col("lo"), F.col("hi") + 1
    one = F.lit(1).cast("long")
    shift = F.call_function  # by a column
    # going up, a block of 2^k starts where rounding to multiples of 2^k has moved the start and it still fits
    up_at = lambda k: F.ceil(lo / shift("shiftleft", one, k)).cast("long") * shift("shiftleft", one, k)
    down_at = lambda k: F.floor(end / shift("shiftleft", one, k)).cast("long") * shift("shiftleft", one, k)
    ups = F.filter(bits, lambda k: (shift("shiftright", up_at(k), k).bitwiseAND(F.lit(1)) == 1) & (up_at(k) + shift("shiftleft", one, k) <= end))
    downs = F.filter(bits, lambda k: (shift("shiftright", down_at(k), k).bitwiseAND(F.lit(1)) == 1) & (down_at(k) - shift("shiftleft", one, k) >= lo))
    rows = F.concat(F.transform(ups, lambda k: F.struct(up_at(k).alias("lo"), k.alias("k"))), F.transform(downs, lambda k: F.struct((down_at(k) - shift("shiftleft", one, k)).alias("lo"), k.alias("k"))))
    rows = F.when((lo == 0) & (end == (1 << 32)), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(32).alias("k")))).otherwise(F.array_distinct(rows))
    out = ranges.select(F.explode(rows).alias("x")).select("x.lo", (32 - F.col("x.k")).alias("prefix"))
    return out.withColumn("cidr", F.concat_ws("/", ipv4_text(F.col("lo")), "prefix"))


def split(networks: DataFrame, cidr: str, prefix: int) -> DataFrame:
    """(cidr, subnet, lo) of every subnet of ``prefix`` bits, in order by lo; one network's own prefix gives itself.

    Raises for a prefix out of range; networks that are malformed or smaller give none.
    """
    if not 0 <= prefix <= 32:
        raise BadNetwork(f"prefix {prefix}")
    step = 1 << (32 - prefix)
    n = networks.select(cidr, ipv4_network(F.col(cidr)).alias("n")).where(f"n is not null and n.prefix <= {prefix} and {prefix} - n.prefix <= 24")
    rows = n.select(cidr, F.explode(F.sequence(F.col("n.lo"), F.col("n.hi"), F.lit(step).cast("long"))).alias("lo"))
    return rows.select(cidr, F.concat_ws("/", ipv4_text(F.col("lo")), F.lit(prefix)).alias("subnet"), "lo")


#: Bits of the part of the address space that one group of networks lies in, by family.
_PART = {4: 8, 6: 16}


def _placed(cidrs: pd.Series) -> pd.DataFrame:
    """A network's part, and whether the network lies within one."""
    rows = []
    for x in cidrs:
        n = ipaddress.ip_network(x, strict=False)
        rows.append((n.version, int(n.network_address) >> (n.max_prefixlen - _PART[n.version]), n.prefixlen > _PART[n.version], n.prefixlen))
    return pd.DataFrame(rows, columns=["family", "part", "narrow", "prefix"])


def _with_place(networks: DataFrame) -> DataFrame:
    place = F.pandas_udf(_placed, "family int, part int, narrow boolean, prefix int")
    return networks.withColumn("at", place("cidr")).select("cidr", "at.*")


def _collapsed(pdf: pd.DataFrame) -> pd.DataFrame:
    nets = [ipaddress.ip_network(x, strict=False) for x in pdf["cidr"]]
    return pd.DataFrame({"cidr": [str(n) for v in (4, 6) for n in ipaddress.collapse_addresses(x for x in nets if x.version == v)]})


def merge_any(networks: DataFrame, cidr: str) -> DataFrame:
    """(cidr): the minimal cover of networks of either family; repeated ones count once.

    Networks within a part of the address space (a /8 of IPv4, a /16 of IPv6) are merged
    part by part.  What is as wide as a part, given or merged, meets in one task: at most
    2 * (2^8 + 2^16) different networks.  Networks in parts that those cover then go.
    A malformed network raises.
    """
    at = _with_place(networks.select(F.col(cidr).alias("cidr")).where(F.col("cidr").isNotNull()).distinct())
    merged = _with_place(at.where("narrow").groupBy("family", "part").applyInPandas(_collapsed, "cidr string"))
    wide = at.where("not narrow").select("cidr").unionByName(merged.where("not narrow").select("cidr"))
    wide = _with_place(wide.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_collapsed, "cidr string"))
    border = F.when(F.col("family") == 4, _PART[4]).otherwise(_PART[6])
    reach = F.call_function("shiftleft", F.lit(1), border - F.col("prefix"))
    covered = wide.select("family", F.explode(F.sequence("part", F.col("part") + reach - 1)).alias("part"))
    return wide.select("cidr").unionByName(merged.where("narrow").join(covered, ["family", "part"], "left_anti").select("cidr"))


def _keys(lengths: list[tuple[int, int]]):
    """Columns of an address's networks of the given (family, prefix), as texts; none for what is no address."""

    @F.pandas_udf("array<string>")
    def run(ips: pd.Series) -> pd.Series:
        def one(text):
            try:
                x = ipaddress.ip_address(text)
            except ValueError:
                return []
            if x.version == 6 and x.ipv4_mapped:
                x = x.ipv4_mapped
            n, value = x.max_prefixlen, int(x)
            return [f"{v}/{p}/{value >> (n - p):x}" for v, p in lengths if v == x.version]

        return ips.map(one)

    return run


def _network_keys(cidrs: pd.Series) -> pd.DataFrame:
    rows = []
    for x in cidrs:
        try:
            n = ipaddress.ip_network(x, strict=False)
        except ValueError:
            rows.append((None, None, None))
            continue
        rows.append((n.version, n.prefixlen, f"{n.version}/{n.prefixlen}/{int(n.network_address) >> (n.max_prefixlen - n.prefixlen):x}"))
    out = pd.DataFrame(rows, columns=["family", "prefix", "key"], dtype=object)
    return out.assign(family=out["family"].astype("Int32"), prefix=out["prefix"].astype("Int32"))


def contains_any(addresses: DataFrame, networks: DataFrame, ip: str, cidr: str) -> DataFrame:
    """(ip, hit) for each distinct address of either family: whether any network holds it.

    The join of ``contains`` on at most 33 + 129 prefix lengths.  IPv4-mapped addresses
    count as IPv4; malformed networks are skipped, malformed addresses are in none.
    """
    nets = networks.select(F.col(cidr).alias("cidr")).where(F.col("cidr").isNotNull()).distinct()
    nets = nets.select(F.pandas_udf(_network_keys, "family int, prefix int, key string")("cidr").alias("n")).where("n.key is not null").select("n.*").distinct()
    lengths = [(r["family"], r["prefix"]) for r in nets.select("family", "prefix").distinct().collect()]
    asked = addresses.select(ip).where(F.col(ip).isNotNull()).distinct()
    if not lengths:
        return asked.select(ip, F.lit(False).alias("hit"))
    hits = asked.select(ip, F.explode(_keys(lengths)(ip)).alias("key")).join(nets.select("key"), "key", "left_semi").select(ip).distinct()
    return asked.join(hits.withColumn("_h", F.lit(True)), ip, "left").select(ip, F.coalesce("_h", F.lit(False)).alias("hit"))


def split_ipv6(networks: DataFrame, cidr: str, prefix: int) -> DataFrame:
    """(cidr, subnet) of every IPv6 subnet of ``prefix`` bits, as ``split``: at most 2^24 of a network, else none."""
    if not 0 <= prefix <= 128:
        raise BadNetwork(f"prefix {prefix}")

    @F.pandas_udf("int")
    def bits(cidrs: pd.Series) -> pd.Series:
        def one(x):
            try:
                return prefix - ipaddress.IPv6Network(x, strict=False).prefixlen
            except ValueError:
                return -1

        return cidrs.map(one)

    @F.pandas_udf("string")
    def subnet(cidrs: pd.Series, places: pd.Series) -> pd.Series:
        base = {x: int(ipaddress.IPv6Network(x, strict=False).network_address) for x in cidrs.unique()}
        return pd.Series([f"{ipaddress.IPv6Address(base[x] + (int(k) << (128 - prefix)))}/{prefix}" for x, k in zip(cidrs, places, strict=True)], dtype=object)

    n = networks.select(cidr).where(F.col(cidr).isNotNull()).withColumn("_bits", bits(cidr)).where("_bits between 0 and 24")
    rows = n.select(cidr, F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("_bits")) - 1)).alias("_k"))
    return rows.select(cidr, subnet(cidr, "_k").alias("subnet"))
