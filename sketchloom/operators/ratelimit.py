"""Per-key fixed windows that start at a key's first event and end inclusively.

Not ``window()``: that is aligned and half-open.  Keys are independent, so a trace is
replayed key by key; the bound on the number of keys is global and needs one ordered replay.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import fold

WINDOW, MAX_KEYS = 60.0, 1000


class FixedWindow:
    """The counter: ``allow`` counts and locks above the limit, ``add`` counts only."""

    def __init__(self, window: float = WINDOW, max_keys: int | None = None):
        self.window = window if window > 0 else WINDOW
        self.max_keys = None if max_keys is None else max_keys if max_keys > 0 else MAX_KEYS
        self.keys: dict = {}
        self._ends: list[tuple] = []  # a heap of (end, key's text, age of the key, key); old ends of a key stay until they are met
        self._age = 0

    def _entry(self, key, now: float) -> list:
        e = self.keys.get(key)
        if e is None:
            if self.max_keys and len(self.keys) >= self.max_keys:
                self._evict(now)
            self._age += 1
            e = self.keys[key] = [0, False, now + self.window, self._age]
        elif now > e[2]:  # the end itself still belongs to the window
            e[:3] = [0, False, now + self.window]
        else:
            return e
        if self.max_keys:
            heapq.heappush(self._ends, (e[2], str(key), e[3], key))
            if len(self._ends) > 2 * self.max_keys + 16:
                self._ends = [(x[2], str(k), x[3], k) for k, x in self.keys.items()]
                heapq.heapify(self._ends)
        return e

    def _evict(self, now: float) -> None:
        """Drop what has expired, else the window that ends first (ties by key)."""
        dropped = False
        while self._ends:
            end, _, age, key = self._ends[0]
            e = self.keys.get(key)
            if e is not None and e[3] == age and e[2] == end:
                if dropped and not now > end:
                    return
                del self.keys[key]
                dropped = True
                if not now > end:
                    heapq.heappop(self._ends)
                    return
            heapq.heappop(self._ends)

    def allow(self, key, limit: int, now: float) -> bool:
        e = self._entry(key, now)
        e[0] += 1
        e[1] = e[1] or e[0] > limit
        return not e[1]

    def add(self, key, delta: int, now: float) -> int:
        if delta <= 0:
            return self.count(key, now)
        e = self._entry(key, now)
        e[0] += delta
        return e[0]

    def count(self, key, now: float) -> int:
        e = self.keys.get(key)
        return 0 if e is None or now > e[2] else e[0]


def _micros(window: float) -> int:
    return round((window if window > 0 else WINDOW) * 1e6)


def replay(df: DataFrame, key: str, time: str, tie: str, limit: int, window: float = WINDOW, amount: str | None = None) -> DataFrame:
    """Each event with ``allowed``, the window's ``count`` and ``window_end`` just after it.

    Without ``amount`` every event asks to be allowed; with it, events only add so much
    (a null adds nothing).  Times are whole microseconds, so a window's end is exact.
    """

    def step(w: FixedWindow, now: int, n: int | None = None):
        if amount is None:
            ok = w.allow(0, limit, now)
        else:
            w.add(0, n or 0, now)
            ok = not (0 in w.keys and w.keys[0][1])
        return ok, w.count(0, now), w.keys[0][2] if 0 in w.keys else now

    inputs = [time] if amount is None else [time, amount]
    return fold(df, [key], [time, tie], inputs, lambda: FixedWindow(_micros(window)), step, "allowed boolean, count bigint, window_end timestamp")


def state_at(replayed: DataFrame, key: str, time: str, tie: str, at) -> DataFrame:
    """(key, count, locked, expiry) as of an instant: 0, false and null once the window has ended."""
    t = F.lit(at).cast("timestamp")
    last = replayed.where(F.col(time) <= t).groupBy(key).agg(F.max_by(F.struct("allowed", "count", "window_end"), F.struct(time, tie)).alias("x"))
    over = t > F.col("x.window_end")
    return last.select(key, F.when(over, 0).otherwise(F.col("x.count")).cast("long").alias("count"), (~over & ~F.col("x.allowed")).alias("locked"), F.when(~over, F.col("x.window_end")).alias("expiry"))


def replay_bounded(df: DataFrame, key: str, time: str, tie: str, limit: int, window: float, max_keys: int) -> DataFrame:
    """Each event with ``allowed`` under a bound on all keys at once: a simulation in one ordered task."""

    def step(w: FixedWindow, k, now: int):
        return (w.allow(k, limit, now),)

    return fold(df, [], [time, tie], [key, time], lambda: FixedWindow(_micros(window), max_keys), step, "allowed boolean")
