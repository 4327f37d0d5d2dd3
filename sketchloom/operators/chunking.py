"""Content-defined chunking with a gear hash, and deduplication by chunk hash."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KB, MB = 1 << 10, 1 << 20


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes; ``normalization`` (0 to 3) pulls chunk sizes towards the average."""

    least: int = 512 * KB
    average: int = MB
    most: int = 8 * MB
    normalization: int = 2
    algorithm: str = "sha256"

    def __post_init__(self):
        if not 0 < self.least <= self.average <= self.most:
            raise ValueError("sizes must be positive and in order")
        if not 0 <= self.normalization <= 3:
            raise ValueError("normalization must be 0 to 3")

    def masks(self) -> tuple[int, int]:
        """The harder mask, for chunks below the average, and the easier one."""
        bits = self.average.bit_length() - 1
        return _mask(min(bits + self.normalization, 63)), _mask(max(bits - self.normalization, 1))


DEFAULT = Chunking()
SMALL = Chunking(2 * KB, 8 * KB, 64 * KB)
MEDIUM = Chunking(16 * KB, 64 * KB, 256 * KB)
LARGE = Chunking(64 * KB, 256 * KB, 2 * MB)


def _mask(bits: int) -> int:
    step = 64 // bits
    return sum(1 << (63 - k * step) for k in range(bits))


#: 256 random-looking words, fixed by a public hash.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([k])).digest()[:8], "big") for k in range(256)], np.uint64)


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash after each byte, as if it began 64 bytes before: h = (h << 1) + gear[byte].

    A byte leaves the hash after 64 shifts, so the sum of 64 shifted columns is the hash;
    doubling makes that six vector steps.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 64:
        out = h.copy()
        out[span:] += h[:-span] << np.uint64(span)
        h, span = out, span * 2
    return h


def boundaries(data: bytes, c: Chunking) -> list[int]:
    """The end of each chunk.  An end depends on the 64 bytes before it and the chunk's start only."""
    if not data:
        return []
    h = gear_hashes(data)
    hard, easy = c.masks()
    stops = [np.flatnonzero((h & np.uint64(m)) == 0) for m in (hard, easy)]
    ends, start, n = [], 0, len(data)
    while start < n:
        left = n - start
        if left <= c.least:
            ends.append(n)
            break
        middle, last = start + min(c.average, left), start + min(c.most, left)
        end = last
        for places, a, b in ((stops[0], start + c.least, middle), (stops[1], middle, last)):
            k = np.searchsorted(places, a)
            if k < len(places) and places[k] < b:
                end = int(places[k]) + 1
                break
        ends.append(end)
        start = end
    return ends


def chunk(df: DataFrame, data: str, columns: list[str], c: Chunking = DEFAULT, with_data: bool = False) -> DataFrame:
    """(columns, offset, length, hash and, if asked for, data) of every chunk; empty data has none."""
    source = df.select(*columns, F.col(data).cast("binary").alias("_data"))
    kinds = dict(source.dtypes)
    hasher = getattr(hashlib, c.algorithm if c.algorithm in ("sha256", "sha384", "sha512") else "sha256")

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                raw, start = row[-1] or b"", 0
                for end in boundaries(raw, c):
                    part = raw[start:end]
                    rows.append((*row[:-1], start, end - start, hasher(part).hexdigest(), *((part,) if with_data else ())))
                    start = end
            yield pd.DataFrame(rows, columns=[*columns, "offset", "length", "hash", *(["data"] if with_data else [])])

    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in columns), "offset bigint, length bigint, hash string", *(["data binary"] if with_data else [])])
    return source.mapInPandas(run, schema)


def duplicates(chunks: DataFrame) -> DataFrame:
    """(hash, n, length) of chunks by hash."""
    return chunks.groupBy("hash").agg(F.count("*").alias("n"), F.max("length").alias("length"))


def dedup_ratio(chunks: DataFrame) -> DataFrame:
    """(bytes, unique_bytes, ratio): the share of bytes that repeats."""
    return duplicates(chunks).agg(F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sum("length").alias("unique_bytes")).withColumn("ratio", 1 - F.col("unique_bytes") / F.col("bytes"))
