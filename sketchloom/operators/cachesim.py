"""Replay of access traces through an adaptive replacement cache.

Two lists hold entries seen once and more than once, two more remember what left them; a
set of a remembered key moves the target size of the first list.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import fold


class AdaptiveCache:
    def __init__(self, max_items: int = 1000, max_bytes: int = 0, default_ttl: float = 0.0, on_evict: Callable | None = None):
        self.size = max_items if max_items > 0 else 1000
        self.max_bytes, self.default_ttl, self.on_evict = max_bytes, default_ttl, on_evict
        self.once, self.often = OrderedDict(), OrderedDict()  # key -> (value, expiry, bytes); the newest last
        self.past_once, self.past_often = OrderedDict(), OrderedDict()
        self.target = 0
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.once) + len(self.often)

    def _leave(self, part: OrderedDict, key, ghosts: OrderedDict | None) -> None:
        value, _, size = part.pop(key)
        self.bytes -= size
        if self.on_evict:
            self.on_evict(key, value)
        if ghosts is not None:
            ghosts[key] = None

    def get(self, key, now: float = 0.0):
        """(value, hit); a remembered key is a miss and adapts nothing."""
        part = self.once if key in self.once else self.often if key in self.often else None
        if part is None:
            return None, False
        entry = part[key]
        if entry[1] is not None and now > entry[1]:
            self._leave(part, key, None)
            return None, False
        del part[key]
        self.often[key] = entry
        return entry[0], True

    def set(self, key, value, ttl: float = 0.0, now: float = 0.0, size: int = 0) -> None:
        """A ttl of 0 means the default, a negative one never."""
        ttl = ttl or self.default_ttl
        entry = (value, now + ttl if ttl > 0 else None, size)
        for part in (self.once, self.often):
            if key in part:
                self.bytes += size - part.pop(key)[2]
                self.often[key] = entry
                self._shrink()
                return
        if key in self.past_once or key in self.past_often:
            recent = key in self.past_once
            mine, other = (self.past_once, self.past_often) if recent else (self.past_often, self.past_once)
            step = len(other) // len(mine) if len(other) > len(mine) else 1
            self.target = min(self.target + step, self.size) if recent else max(self.target - step, 0)
            self._replace(not recent)
            mine.pop(key, None)
            self.often[key] = entry
        else:
            self._make_room()
            self.once[key] = entry
        self.bytes += size
        self._shrink()

    def _make_room(self) -> None:
        held = len(self)
        known = held + len(self.past_once) + len(self.past_often)
        if held >= self.size:
            if len(self.once) < self.size:
                if known >= 2 * self.size and (self.past_often or self.past_once):
                    (self.past_often or self.past_once).popitem(last=False)
                self._replace(False)
            else:
                key = next(iter(self.once))
                if len(self.past_once) + len(self.past_often) >= self.size and self.past_once:
                    self.past_once.popitem(last=False)
                self._leave(self.once, key, self.past_once)
        elif known >= self.size:
            if known >= 2 * self.size and self.past_often:
                self.past_often.popitem(last=False)
            elif self.past_once:
                self.past_once.popitem(last=False)

    def _replace(self, from_often: bool) -> None:
        n = len(self.once)
        if n and (n > self.target or (n == self.target and from_often) or not self.often):
            self._leave(self.once, next(iter(self.once)), self.past_once)
        elif self.often:
            self._leave(self.often, next(iter(self.often)), self.past_often)

    def _shrink(self) -> None:
        while self.max_bytes > 0 and self.bytes > self.max_bytes and len(self):
            self._replace(False)

    def delete(self, key) -> bool:
        for part in (self.once, self.often):
            if key in part:
                self._leave(part, key, None)
                return True
        return bool(self.past_once.pop(key, 0) is None or self.past_often.pop(key, 0) is None) and False

    def clear(self) -> None:
        for part in (self.once, self.often, self.past_once, self.past_often):
            part.clear()
        self.target = self.bytes = 0


def replay(df: DataFrame, cache: str, key: str, order: list[str], max_items: int, ttl: float = 0.0, time: str | None = None, size: str | None = None, max_bytes: int = 0) -> DataFrame:
    """Each access with ``hit``, ``target``, ``resident`` and ``evicted``: a get, and a set if it missed.

    Caches (values of ``cache``) are independent; each trace is replayed in its order.
    """

    def start():
        c = AdaptiveCache(max_items, max_bytes, on_evict=lambda *_: gone.__setitem__(0, gone[0] + 1))
        gone = [0]
        return c, gone

    def step(state, k, *more):
        c, gone = state
        now = more[0] / 1e6 if time else 0.0
        _, hit = c.get(k, now)
        if not hit:
            c.set(k, True, ttl, now, int(more[-1] or 0) if size else 0)
        return hit, c.target, len(c), gone[0]

    inputs = [key, *([time] if time else []), *([size] if size else [])]
    return fold(df, [cache], order, inputs, start, step, "hit boolean, target bigint, resident bigint, evicted bigint")


def hit_ratio(replayed: DataFrame, cache: str) -> DataFrame:
    return replayed.groupBy(cache).agg(F.count("*").alias("accesses"), F.sum(F.col("hit").cast("long")).alias("hits"))
