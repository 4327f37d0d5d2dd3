"""Rounding to places, random integers and time-ordered ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round64(value: Column, places: int) -> Column:
    """Half away from zero, in binary: ``round(v, p)`` goes by the decimal digits and differs."""
    return F.round(value * 10.0**places, 0) / 10.0**places


def round64_up(value: Column, places: int) -> Column:
    return F.ceil(value * 10.0**places) / 10.0**places


def round64_down(value: Column, places: int) -> Column:
    return F.floor(value * 10.0**places) / 10.0**places


def rand_int(low: int, high: int, seed: int) -> Column:
    """A random integer in [low, high)."""
    if high <= low:
        raise ValueError("high must be above low")
    return (F.floor(F.rand(seed) * (high - low)) + low).cast("long")


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz".translate({ord("i"): None, ord("o"): None})


def base34(number: Column, places: int = 12) -> Column:
    """The last ``places`` base-34 digits of a non-negative long; the alphabet leaves out i and o."""
    digit = lambda k: F.substring(F.lit(_DIGITS), F.pmod(F.floor(number / F.lit(34**k).cast("decimal(20,0)")), F.lit(34)).cast("int") + 1, F.lit(1))
    return F.concat(*(digit(k) for k in reversed(range(places))))


def uxid(time: Column, seed: Column) -> Column:
    """24 characters: 12 of the time in nanoseconds, so that ids sort by time, and 12 of a hash of ``seed``."""
    nanos = F.unix_micros(time).cast("decimal(20,0)") * 1000
    rest = F.xxhash64(seed).bitwiseAND(F.lit((1 << 60) - 1)).cast("decimal(20,0)")
    return F.concat(base34(nanos), base34(rest))
