"""Prefix lookups: a dimension table by string key, with prefix joins by hash, not by scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(*tables: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """One row a key; later tables win.  Also the merge of two trees."""
    ranked = [t.select(key, value, F.lit(k).alias("_seq")) for k, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, ranked).groupBy(key).agg(F.max_by(value, F.struct("_seq", value)).alias(value))


def get(table: DataFrame, probes: DataFrame, probe: str, key: str = "key", value: str = "value") -> DataFrame:
    """(probe, value): exact matches; null where there is none."""
    return probes.select(probe).distinct().join(table.select(F.col(key).alias(probe), value), probe, "left")


def delete(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_anti")


def delete_prefix(table: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return table.where(~F.col(key).startswith(prefix))


def prefix_search(table: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """All rows under a prefix; reaches a Parquet scan as StringStartsWith."""
    return table.where(F.col(key).startswith(prefix))


def has_prefix(table: DataFrame, prefix: str, key: str = "key") -> bool:
    return not prefix_search(table, prefix, key).limit(1).isEmpty()


def _prefixes(value: Column, lengths: list[int]) -> Column:
    own = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(value))
    return F.transform(own, lambda n: F.substring(value, F.lit(1), n))


def prefix_matches(table: DataFrame, probes: DataFrame, probe: str, key: str = "key", value: str = "value") -> DataFrame:
    """(probe, key, value) of every stored prefix of each distinct probe, the empty key included.

    Probes explode to their prefixes of the lengths that the table has, which meet the keys
    in an equi-join.
    """
    lengths = sorted(r["n"] for r in table.select(F.length(key).alias("n")).distinct().collect())  # at most the longest key
    asked = probes.select(probe).where(F.col(probe).isNotNull()).distinct()
    if not lengths:
        return asked.join(table.select(key, value), F.lit(False))
    return asked.select(probe, F.explode(_prefixes(F.col(probe), lengths)).alias(key)).join(table.select(key, value), key)


def longest_prefix(table: DataFrame, probes: DataFrame, probe: str, key: str = "key", value: str = "value", shortest: bool = False) -> DataFrame:
    """(probe, key, value): the longest (or shortest) stored prefix of each probe that has one."""
    best = (F.min_by if shortest else F.max_by)(F.struct(key, value), F.length(key))
    return prefix_matches(table, probes, probe, key, value).groupBy(probe).agg(best.alias("x")).select(probe, f"x.{key}", f"x.{value}")
