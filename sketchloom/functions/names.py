"""Host and zone names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))


def domain_from_hostname(name: Column) -> Column:
    """What follows the first dot, or null."""
    at = F.instr(name, ".")
    return F.when(at > 0, F.substring(name, at + 1, F.length(name)))


def domain_name_guesses(name: Column) -> Column:
    """All suffixes by whole labels, the name itself first."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def normalize_zone(name: Column) -> Column:
    """With a dot at the end."""
    return F.when(name.endswith("."), name).otherwise(F.concat(name, F.lit(".")))
