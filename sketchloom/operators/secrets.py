"""Secret sharing: polynomials over a 256-bit prime field, and bytewise over GF(2^8).

Splits are one row to many.  Combines first bring a secret's few shares into one row, so
Python is called for a batch of secrets and not for each.  Coefficients come from the
system's random source, or from a seed for tests.
"""

from __future__ import annotations

import base64
import hashlib
import secrets as _random
import struct
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest prime below 2^256.
PRIME = 2**256 - 189
BLOCK = 31


class ShareError(ValueError):
    pass


def _source(seed):
    """A function of (n) that gives a number in [0, n)."""
    if seed is None:
        return _random.randbelow
    state = [0]

    def draw(n: int) -> int:
        state[0] += 1
        return int.from_bytes(hashlib.sha512(f"{seed}:{state[0]}".encode()).digest(), "big") % n

    return draw


def _checked(threshold: int, total: int) -> None:
    if threshold < 2:
        raise ShareError("threshold must be at least 2")
    if total < threshold:
        raise ShareError("fewer shares than the threshold")


def split(secret: bytes, threshold: int, total: int, xs: list[int] | None = None, seed=None) -> list[tuple[int, int]]:
    """Shares (x, y) of a secret below the prime."""
    _checked(threshold, total)
    value = int.from_bytes(secret, "big")
    if not secret or value >= PRIME:
        raise ShareError("the secret is empty or too large")
    xs = list(range(1, total + 1)) if xs is None else xs
    if len(xs) != total or len(set(xs)) != total or any(x % PRIME == 0 for x in xs):
        raise ShareError("x must be distinct and not 0")
    draw = _source(seed)
    terms = [value, *(draw(PRIME) for _ in range(threshold - 2)), 1 + draw(PRIME - 1)]
    out = []
    for x in xs:
        y = 0
        for t in reversed(terms):
            y = (y * x + t) % PRIME
        out.append((x, y))
    return out


@lru_cache(maxsize=256)
def _weights(xs: tuple[int, ...], at: int) -> tuple[int, ...]:
    """What each y counts for at a place; it depends on the x alone, and many secrets share them."""
    out = []
    for j, x in enumerate(xs):
        top = bottom = 1
        for k, other in enumerate(xs):
            if k != j:
                top, bottom = top * (at - other) % PRIME, bottom * (x - other) % PRIME
        out.append(top * pow(bottom, -1, PRIME) % PRIME)
    return tuple(out)


def value_at(shares: list[tuple[int, int]], at: int = 0) -> int:
    """The polynomial through the shares, at a place."""
    weights = _weights(tuple(x for x, _ in shares), at)
    return sum(y * w for (_, y), w in zip(shares, weights, strict=True)) % PRIME


def combine(shares: list[tuple[int, int]], threshold: int, length: int | None = None) -> bytes:
    """The secret from the first ``threshold`` shares, padded to ``length`` if given."""
    if len(shares) < threshold:
        raise ShareError("not enough shares")
    used = shares[:threshold]
    if len({x for x, _ in used}) < threshold:
        raise ShareError("shares repeat")
    value = value_at(used)
    size = (value.bit_length() + 7) // 8
    if length is not None and size > length:
        raise ShareError("the secret is longer than asked for")
    return value.to_bytes(size if length is None else length, "big")


def verify(shares: list[tuple[int, int]], threshold: int) -> bool:
    """Whether all shares beyond the first ``threshold`` lie on their curve; with none beyond, true."""
    if len(shares) < threshold:
        raise ShareError("not enough shares")
    return all(value_at(shares[:threshold], x) == y for x, y in shares[threshold:])


def split_bytes(data: bytes, threshold: int, total: int, seed=None) -> list[tuple[int, list[int]]]:
    """Shares (x, ys) of data of any length, in blocks of 31 bytes under a shared x."""
    if not data:
        raise ShareError("the secret is empty")
    parts = [split(data[k : k + BLOCK] if any(data[k : k + BLOCK]) else b"\0", threshold, total, seed=None if seed is None else f"{seed}/{k}") for k in range(0, len(data), BLOCK)]
    return [(parts[0][j][0], [p[j][1] for p in parts]) for j in range(total)]


def combine_bytes(shares: list[tuple[int, list[int]]], threshold: int, length: int) -> bytes:
    out = b""
    for k in range(0, length, BLOCK):
        out += combine([(x, ys[k // BLOCK]) for x, ys in shares], threshold, min(BLOCK, length - k))
    return out


def encode_share(x: int, y: int, threshold: int, total: int) -> str:
    """Base64 of version 1: a header of 9 bytes and two numbers of 32."""
    return base64.b64encode(struct.pack(">BII", 1, threshold, total) + x.to_bytes(32, "big") + y.to_bytes(32, "big")).decode()


def decode_share(text: str) -> tuple[int, int, int, int]:
    """(x, y, threshold, total)."""
    try:
        raw = base64.b64decode(text, validate=True)
    except ValueError as e:
        raise ShareError("not base64") from e
    if len(raw) != 73 or raw[0] != 1:
        raise ShareError("not a share of version 1")
    _, threshold, total = struct.unpack(">BII", raw[:9])
    return int.from_bytes(raw[9:41], "big"), int.from_bytes(raw[41:], "big"), threshold, total


# --- GF(2^8) ------------------------------------------------------------------------------


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(512, np.int64), np.zeros(256, np.int64), 1
    for k in range(255):
        exp[k] = exp[k + 255] = x
        log[x] = k
        x ^= x << 1  # times 3, a generator
        if x & 256:
            x ^= 0x11B
    return exp, log


_EXP, _LOG = _tables()


def _products() -> np.ndarray:
    """The product of every two bytes."""
    a = np.arange(256)
    out = _EXP[_LOG[a][:, None] + _LOG[a][None, :]]
    out[0, :] = out[:, 0] = 0
    return out.astype(np.uint8)


_TIMES = _products()


def _draws(count: int, total: int, seed) -> tuple[list[int], bytes]:
    """``total`` distinct places from 1 to 255, and ``count`` random bytes."""
    draw = _source(seed)
    xs = list(range(1, 256))
    for k in range(total):  # distinct and random
        j = k + draw(255 - k)
        xs[k], xs[j] = xs[j], xs[k]
    if seed is None:
        return xs[:total], _random.token_bytes(count)
    head = f"{seed}:"
    return xs[:total], bytes(hashlib.sha512(f"{head}{k}".encode()).digest()[-1] for k in range(total + 1, total + 1 + count))


def split_gf256_many(data: list[bytes], threshold: int, total: int, seeds: list) -> list[list[bytes]]:
    """``split_gf256`` of each secret, over the bytes of all of them at once."""
    _checked(threshold, total)
    if total > 255 or not all(data):
        raise ShareError("1 to 255 shares of a secret that is not empty")
    if not data:
        return []
    sizes = np.array([len(s) for s in data])
    ends = np.cumsum(sizes).tolist()
    drawn = [_draws(len(s) * (threshold - 1), total, seed) for s, seed in zip(data, seeds, strict=True)]
    terms = [np.frombuffer(b"".join(data), np.uint8)]
    for j in range(threshold - 1):
        terms.append(np.frombuffer(b"".join(r[j * len(s) : (j + 1) * len(s)] for s, (_, r) in zip(data, drawn, strict=True)), np.uint8))
    out: list[list[bytes]] = [[] for _ in data]
    for j in range(total):
        places = [xs[j] for xs, _ in drawn]
        x = np.repeat(np.array(places, np.uint8), sizes)
        y = terms[-1]
        for t in reversed(terms[:-1]):
            y = _TIMES[y, x] ^ t
        y, start = y.tobytes(), 0
        for found, end, place in zip(out, ends, places, strict=True):
            found.append(y[start:end] + bytes([place]))
            start = end
    return out


def split_gf256(secret: bytes, threshold: int, total: int, seed=None) -> list[bytes]:
    """Shares with x in their last byte, for up to 255 of them."""
    return split_gf256_many([secret], threshold, total, [seed])[0]


def combine_gf256_many(groups: list[list[bytes]]) -> list[bytes]:
    """``combine_gf256`` of each list of shares, over the bytes of all lists of one length at once."""
    alike = defaultdict(list)
    for k, shares in enumerate(groups):
        if len(shares) < 2 or len({len(s) for s in shares}) > 1 or len(shares[0]) < 2:
            raise ShareError("two or more shares of one length")
        xs = {s[-1] for s in shares}
        if len(xs) < len(shares) or 0 in xs:
            raise ShareError("shares repeat")
        alike[len(shares)].append(k)
    out = [b""] * len(groups)
    for n, members in alike.items():
        sizes = np.array([len(groups[k][0]) - 1 for k in members])
        xs = np.array([[s[-1] for s in groups[k]] for k in members])
        total = np.zeros(sizes.sum(), np.uint8)
        for j in range(n):
            weight = np.zeros(len(members), np.int64)
            for k in range(n):
                if k != j:
                    weight += _LOG[xs[:, k]] - _LOG[xs[:, j] ^ xs[:, k]]
            y = np.frombuffer(b"".join(groups[k][j][:-1] for k in members), np.uint8)
            total ^= _TIMES[y, np.repeat(_EXP[weight % 255], sizes)]
        data, start = total.tobytes(), 0
        for k, end in zip(members, np.cumsum(sizes).tolist(), strict=True):
            out[k] = data[start:end]
            start = end
    return out


def combine_gf256(shares: list[bytes]) -> bytes:
    """The secret from all given shares."""
    return combine_gf256_many([shares])[0]


# --- tables -------------------------------------------------------------------------------

#: Bytes of secrets or shares that are taken together; a single one may be longer.
_TOGETHER = 1 << 22


def _runs(sizes: list[int]):
    """Slices (start, end) of at most ``_TOGETHER`` bytes, of one item at least."""
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and held + n > _TOGETHER:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly: a small file can be one task, and its rows take far longer to split than to read."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _seed(seed, key):
    return None if seed is None else f"{seed}:{key}"


def _split(df: DataFrame, key: str, data: str, run, schema: str) -> DataFrame:
    """(key, what ``run(keys, secrets)`` gives): it yields lists of places in the lists and columns of new values."""
    kinds = dict(df.dtypes)

    def over(batches):
        for batch in batches:
            for places, columns in run(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({key: batch.column(0).take(pa.array(places, pa.int64())), **columns})

    return _dealt(df.select(key, F.col(data).cast("binary").alias("_data"))).mapInArrow(over, f"`{key}` {kinds[key]}, {schema}")


def _combined(shares: DataFrame, key: str, aggregates: list, run, schema: str) -> DataFrame:
    """(key, what ``run(*columns)`` gives for the aggregates of all rows of a batch of keys)."""
    kinds = dict(shares.dtypes)

    def over(batches):
        for batch in batches:
            columns = run(*(c.to_pylist() for c in batch.columns[1:]))
            yield pa.RecordBatch.from_pydict({key: batch.column(0), **columns})

    return shares.groupBy(key).agg(*aggregates).mapInArrow(over, f"`{key}` {kinds[key]}, {schema}")


def split_table(df: DataFrame, key: str, secret: str, threshold: int, total: int, seed=None) -> DataFrame:
    """(key, length, share): ``total`` rows for each secret."""

    def run(keys, data):
        places, lengths, out = [], [], []
        for j, (k, s) in enumerate(zip(keys, data, strict=True)):
            found = [encode_share(x, y, threshold, total) for x, y in split(s, threshold, total, seed=_seed(seed, k))]
            places += [j] * len(found)
            lengths += [len(s)] * len(found)
            out += found
        yield places, {"length": pa.array(lengths, pa.int32()), "share": pa.array(out, pa.string())}

    return _split(df, key, secret, run, "length int, share string")


def combine_table(shares: DataFrame, key: str) -> DataFrame:
    """(key, secret, verified) from rows (key, length, share)."""

    def run(lengths, groups):
        found, verified = [], []
        for length, group in zip(lengths, groups, strict=True):
            parts = [decode_share(s) for s in sorted(group)]
            points, threshold = [(x, y) for x, y, _, _ in parts], parts[0][2]
            found.append(combine(points, threshold, int(length)))
            verified.append(verify(points, threshold))
        return {"secret": pa.array(found, pa.binary()), "verified": pa.array(verified, pa.bool_())}

    aggregates = [F.first("length"), F.collect_list(F.coalesce("share", F.lit("")))]  # a null is an error, not left out
    return _combined(shares, key, aggregates, run, "secret binary, verified boolean")


def split_bytes_table(df: DataFrame, key: str, data: str, threshold: int, total: int, seed=None) -> DataFrame:
    """(key, length, threshold, x, ys) for data of any length: ``total`` rows, one number for each block of 31 bytes."""

    def run(keys, secrets):
        for start, end in _runs([len(s or b"") * total for s in secrets]):
            rows = [(j, len(secrets[j]), x, [str(y) for y in ys]) for j in range(start, end) for x, ys in split_bytes(secrets[j], threshold, total, _seed(seed, keys[j]))]
            yield [r[0] for r in rows], {"length": pa.array([r[1] for r in rows], pa.int32()), "threshold": pa.array([threshold] * len(rows), pa.int32()), "x": pa.array([r[2] for r in rows], pa.int32()), "ys": pa.array([r[3] for r in rows], pa.list_(pa.string()))}

    return _split(df, key, data, run, "length int, threshold int, x int, ys array<string>")


def combine_bytes_table(shares: DataFrame, key: str) -> DataFrame:
    """(key, data) from rows of ``split_bytes_table``; a key's shares are few by construction."""

    def run(lengths, thresholds, groups):
        parts = [[(r["x"], [int(y) for y in r["ys"]]) for r in sorted(group, key=lambda r: r["x"])] for group in groups]
        return {"data": pa.array([combine_bytes(p, t, n) for p, t, n in zip(parts, thresholds, lengths, strict=True)], pa.binary())}

    return _combined(shares, key, [F.first("length"), F.first("threshold"), F.collect_list(F.struct("x", "ys"))], run, "data binary")


def split_gf256_table(df: DataFrame, key: str, data: str, threshold: int, total: int, seed=None) -> DataFrame:
    """(key, share): ``total`` bytewise shares for each secret."""

    def run(keys, secrets):
        for start, end in _runs([len(s or b"") * total for s in secrets]):
            found = split_gf256_many(secrets[start:end], threshold, total, [_seed(seed, k) for k in keys[start:end]])
            yield [j for j, group in enumerate(found, start) for _ in group], {"share": pa.array([s for group in found for s in group], pa.binary())}

    return _split(df, key, data, run, "share binary")


def combine_gf256_table(shares: DataFrame, key: str) -> DataFrame:
    """(key, data) from all shares of each key."""

    def run(groups):
        found = []
        for start, end in _runs([sum(map(len, g)) for g in groups]):
            found += combine_gf256_many(groups[start:end])
        return {"data": pa.array(found, pa.binary())}

    return _combined(shares, key, [F.collect_list(F.coalesce("share", F.lit(b"")))], run, "data binary")
