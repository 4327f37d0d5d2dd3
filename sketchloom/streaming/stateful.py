"""Streaming forms: decayed rates and fixed windows as keyed state, and windowed sketches.

Late events: batch sorts by time; a stream folds an event that comes late, within the
watermark, without decay and without moving the clock.  State goes once the watermark
has passed a window's end, or the time at which a rate has decayed to nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _seconds(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64") / 1e6


#: Half-lives after which a rate is forgotten: it is 2^-60 of what it was.
FORGET = 60


class _Rate(StatefulProcessor):
    def __init__(self, key: str, kind: str, time: str, half_life: float):
        self.key, self.time, self.half_life = key, time, half_life if half_life > 0 else 60.0
        self.decay = math.log(2) / self.half_life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rate", "rate double, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rate, last = self.state.get() if self.state.exists() else (0.0, None)
        for pdf in rows:
            for t in _seconds(pdf[self.time]).sort_values():
                if last is not None and t > last:
                    rate *= math.exp(-self.decay * (t - last))
                last = t if last is None or t > last else last
                rate += 1.0
        if last is not None:
            self.state.update((float(rate), float(last)))
            self.handle.registerTimer(self._gone(last))
            yield pd.DataFrame({self.key: [key[0]], "rate": [rate], "last": [pd.Timestamp(round(last * 1e6), unit="us")]})

    def _gone(self, last: float) -> int:
        return math.ceil((last + FORGET * self.half_life) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self._gone(self.state.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def decayed_rates(stream: DataFrame, key: str, time: str, half_life: float, watermark: str = "1 hour") -> DataFrame:
    """(key, rate, last) after each batch, for the keys that it touched; the rate is as of ``last``."""
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, time).withWatermark(time, watermark)
    return rows.groupBy(key).transformWithStateInPandas(_Rate(key, kind, time, half_life), f"`{key}` {kind}, rate double, last timestamp", "Update", "EventTime")


class _Window(StatefulProcessor):
    def __init__(self, key: str, time: str, tie: str, limit: int, window: float):
        self.key, self.time, self.tie, self.limit, self.window = key, time, tie, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "count long, locked boolean, end double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, locked, end = self.state.get() if self.state.exists() else (0, False, None)
        pdf = pd.concat(rows).sort_values([self.time, self.tie])
        allowed = []
        for now in _seconds(pdf[self.time]):
            if end is None or now > end:
                count, locked, end = 0, False, now + self.window
                self.handle.registerTimer(self._gone(end))
            count += 1
            locked = bool(locked or count > self.limit)
            allowed.append(not locked)
        self.state.update((int(count), bool(locked), float(end)))
        yield pdf.assign(allowed=allowed)

    def _gone(self, end: float) -> int:
        return math.floor(end * 1000) + 1  # windows end inclusively

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self._gone(self.state.get()[2]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit(stream: DataFrame, key: str, time: str, tie: str, limit: int, window: float, watermark: str = "1 hour") -> DataFrame:
    """Each event with ``allowed``; windows start at a key's first event and end inclusively."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in stream.dtypes)
    rows = stream.withWatermark(time, watermark)
    return rows.groupBy(key).transformWithStateInPandas(_Window(key, time, tie, limit, window), f"{kinds}, allowed boolean", "Append", "EventTime")


def windowed_distinct(stream: DataFrame, item: str, time: str, window: str, watermark: str) -> DataFrame:
    """(window, sketch, estimate): a native distinct-count sketch of each tumbling window."""
    rows = stream.withWatermark(time, watermark).groupBy(F.window(time, window).alias("window")).agg(F.hll_sketch_agg(item).alias("sketch"))
    return rows.withColumn("estimate", F.hll_sketch_estimate("sketch"))
