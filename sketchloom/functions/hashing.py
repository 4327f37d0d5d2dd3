"""The hash of the relational sketches, and digests of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def h60(value: Column) -> Column:
    """A 60-bit non-negative hash of a string or binary; other engines can compute it too."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


_BITS = {"sha256": 256, "sha384": 384, "sha512": 512}


def digest(data: Column, algorithm: str = "sha256") -> Column:
    """Hex digest; an unknown algorithm means SHA-256."""
    return F.sha2(data.cast("binary"), _BITS.get(algorithm, 256))


def digest32(data: Column, algorithm: str = "sha256") -> Column:
    """The first 32 bytes of the digest, as hex."""
    return F.substring(digest(data, algorithm), 1, 64)


def digest64(data: Column, algorithm: str = "sha256") -> Column:
    """The digest padded with zeros to 64 bytes, as hex."""
    return F.rpad(digest(data, algorithm), 128, "0")
