"""Pieces of a public SentencePiece model, and numpy lattices over equal-length words.

Words of one length advance together: a polynomial hash of every substring is looked up
among the sorted hashes of the pieces.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_TWIST = np.uint64(0xD6E8FEB86659FD93)
_TOP = 20

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    is_bpe: bool
    dummy_prefix: bool
    strips: bool

    @staticmethod
    def load(path: str) -> Model:
        return _load(path)


@lru_cache(4)
def _load(path: str) -> Model:
    pieces, scores, kinds = [], [], []
    trainer, normalizer = {}, {}
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            f = dict(_fields(value))
            pieces.append(f[1].decode())
            scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kinds.append(f.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(2):
        raise ValueError("only models without a character map are supported")
    return Model(pieces, np.array(scores, np.float64), np.array(kinds, np.int8), trainer.get(3, 1) == 2, bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def codes(words: list[str], length: int) -> np.ndarray:
    """Code points of equally long words, as a matrix."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def prefix_hashes(matrix: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, a column for each end from 0; arithmetic modulo 2^64."""
    n, length = matrix.shape
    out = np.zeros((length + 1, n), np.uint64)
    for k in range(length):
        out[k + 1] = out[k] * _B + (matrix[:, k].astype(np.uint64) + np.uint64(1)) * _TWIST
    return out


def powers(n: int) -> np.ndarray:
    return np.array([pow(int(_B), k, 1 << 64) for k in range(n + 1)], np.uint64)


class PieceIndex:
    """Sorted piece hashes; ``find`` gives the ids of substrings, or -1."""

    def __init__(self, pieces: list[str], ids: list[int]):
        hashes = np.empty(len(pieces), np.uint64)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        for length in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == length)
            hashes[own] = prefix_hashes(codes([pieces[k] for k in own], int(length)))[-1]
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(ids, np.int32)[order]
        if len(self.keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.longest = int(self.lengths.max(initial=1))
        self.by_length = []
        sorted_lengths = self.lengths[order]
        for length in range(self.longest + 1):
            own = sorted_lengths == length
            self.by_length.append((self.keys[own], self.ids[own]))
        self.powers = powers(self.longest)
        # by the top bits of a hash: whether any piece has them; spares most searches
        self.filed = np.zeros(1 << _TOP, bool)
        self.filed[hashes >> np.uint64(64 - _TOP)] = True

    def lookup(self, hashes: np.ndarray, length: int) -> np.ndarray:
        keys, ids = self.by_length[length]
        if not len(keys):
            return np.full(len(hashes), -1, np.int32)
        out = np.full(len(hashes), -1, np.int32)
        some = np.flatnonzero(self.filed[hashes >> np.uint64(64 - _TOP)])
        if len(some):
            asked = hashes[some]
            at = np.searchsorted(keys, asked)
            at[at == len(keys)] = 0
            out[some] = np.where(keys[at] == asked, ids[at], np.int32(-1))
        return out

    def find(self, prefixes: np.ndarray, start: int, end: int) -> np.ndarray:
        n = end - start
        return self.lookup(prefixes[end] - prefixes[start] * self.powers[n], n)


def by_length(words: list[str], most: int = 20_000):
    """Groups of equally long words: (length, places in ``words``), at most ``most`` at once."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            length = int(lengths[group[0]])
            step = max(1, min(most, 4_000_000 // max(1, length)))
            for at in range(0, len(group), step):
                yield length, group[at : at + step]
