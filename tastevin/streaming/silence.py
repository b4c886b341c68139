"""Alarms for silence on a stream of heartbeats: state with timers, so an alarm comes although no row does.

`silences` works in event time: each key's open sessions are state, a timer stands at each session's end, and when the watermark has
passed it the session is given out. What comes out is what `offers.stalls` gives over all rows at once, late rows within the
watermark included, in whatever order and batches they come, before or after a restart. `alarms` works in wall-clock
time: a key from which nothing came for the gap is given out once, by a batch without rows if need be, and watched again from its next row.

State is a row for each open session, or one for each key; both go when they are given out. Both need RocksDB's state store, which
`with_timers` sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


class Sessions(StatefulProcessor):
    """Open sessions of a key: (first, last, n), in milliseconds; a row within the gap of one belongs to it."""

    def __init__(self, gap_ms: int, key: str):
        self.gap, self.key = gap_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(_ms(t) for pdf in rows for t in pdf["at"])
        before = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        merged: list[list[int]] = []
        for first, last, n in sorted([*before, *((t, t, 1) for t in times)]):
            if merged and first <= merged[-1][1] + self.gap:
                merged[-1][1:] = [max(merged[-1][1], last), merged[-1][2] + n]
            else:
                merged.append([first, last, n])
        self.open.put([tuple(x) for x in merged])
        ends = {last + self.gap for _, last, _ in merged}
        for old in {last + self.gap for _, last, _ in before} - ends:
            self.handle.deleteTimer(old)
        for end in ends:
            self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        sessions = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        over, left = [s for s in sessions if s[1] + self.gap <= end], [s for s in sessions if s[1] + self.gap > end]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        if over:
            at = lambda x: pd.to_datetime([s for s in x], unit="ms")
            yield pd.DataFrame({self.key: [key[0]] * len(over), "started": at([s[0] for s in over]), "stalled_at": at([s[1] + self.gap for s in over]), "n": [s[2] for s in over]})

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """A key's last row, its wall-clock time, and the timer that the next row moves."""

    def __init__(self, gap_ms: int, key: str):
        self.gap, self.key = gap_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = max((_ms(pdf["at"].max()) for pdf in rows if len(pdf)), default=None)
        if self.last.exists():
            old = self.last.get()
            seen = old[0] if seen is None else max(old[0], seen)
            self.handle.deleteTimer(old[1])
        timer = timerValues.getCurrentProcessingTimeInMs() + self.gap
        self.last.update((seen, timer))
        self.handle.registerTimer(timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            seen, _ = self.last.get()
            self.last.clear()
            yield pd.DataFrame({self.key: [key[0]], "last_seen": pd.to_datetime([seen], unit="ms"), "silent_since": pd.to_datetime([expiredTimerInfo.getExpiryTimeInMs() - self.gap], unit="ms")})

    def close(self) -> None:
        pass


def _rows(events: DataFrame, key: str, at: str) -> DataFrame:
    return events.select(F.col(key), F.col(at).alias("at")).where(F.col(at).isNotNull())


def silences(events: DataFrame, key: str, at: str, gap: timedelta, watermark: str) -> DataFrame:
    """key, started, stalled_at, n: a row for each session of a key, as soon as the watermark is past its end."""
    rows = _rows(events, key, at).withWatermark("at", watermark)
    kind = rows.schema[key].dataType.simpleString()
    made = Sessions(int(gap.total_seconds() * 1000), key)
    return rows.groupBy(key).transformWithStateInPandas(made, f"`{key}` {kind}, started timestamp, stalled_at timestamp, n long", "Append", "EventTime")


def alarms(events: DataFrame, key: str, at: str, gap: timedelta) -> DataFrame:
    """key, last_seen (of its rows), silent_since (wall clock): a row for each time that a key falls silent for the gap."""
    rows = _rows(events, key, at)
    kind = rows.schema[key].dataType.simpleString()
    made = Silence(int(gap.total_seconds() * 1000), key)
    return rows.groupBy(key).transformWithStateInPandas(made, f"`{key}` {kind}, last_seen timestamp, silent_since timestamp", "Append", "ProcessingTime")


def silent_now(beats: DataFrame, key: str, at: str, gap: timedelta, now: datetime | None = None) -> DataFrame:
    """The batch form of `alarms`: keys whose last row is older than the gap."""
    now = now or datetime.now(timezone.utc)
    last = beats.groupBy(key).agg(F.max(at).alias("last_seen"))
    return last.where(F.col("last_seen") < F.lit(now - gap))
