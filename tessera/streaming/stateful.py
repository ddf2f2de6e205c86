"""Streams with state of their own, by transformWithState: values, maps and timers in RocksDB, with an end for idle keys.

A key's state is a few values; of the rows of a key in a batch only those columns are held that the step needs, and
only the rows that can still count.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# State in RocksDB, and no batches without rows: with states that end by the clock they would never cease.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Milliseconds after which the state of a key without rows goes.
IDLE_MS = 90 * 24 * 3600 * 1000


@contextmanager
def rocksdb(spark: SparkSession):
    """Within, queries that are started have the SETTINGS that transformWithState needs."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class FeedCursor(StatefulProcessor):
    """The entries of a source after its cursor, the newest (published, guid) of earlier batches; a guid is given out once."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "published long, guid string", self.idle_ms)
        self.given = handle.getMapState("given", "guid string", "published long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = tuple(self.cursor.get()) if self.cursor.exists() else (-(2**63), "")
        fresh, newest = [], start
        for frame in rows:
            late = (frame["published"] < start[0]) | ((frame["published"] == start[0]) & (frame["guid"] <= start[1]))
            fresh.append(frame.loc[~late, ["published", "guid"]])
        frame = pd.concat(fresh).sort_values(["published", "guid"])
        if len(frame):
            newest = (int(frame["published"].iloc[-1]), str(frame["guid"].iloc[-1]))
            frame = frame.drop_duplicates("guid")
            frame = frame[[not self.given.containsKey((g,)) for g in frame["guid"]]]
            for p, g in zip(frame["published"], frame["guid"], strict=True):
                self.given.updateValue((g,), (int(p),))
            self.cursor.update(newest)
        yield frame.assign(source=key[0])[["source", "guid", "published"]]

    def close(self) -> None:
        pass


class FailureRun(StatefulProcessor):
    """The events at which a key's failures in a row reach `after`; the state is how many of its last events failed."""

    def __init__(self, after: int, idle_ms: int) -> None:
        self.after, self.idle_ms = after, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "run int", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f[["at", "seq", "ok"]] for f in rows]).sort_values(["at", "seq"])
        ok, place = frame["ok"].to_numpy(bool), np.arange(len(frame))
        carried = self.run.get()[0] if self.run.exists() else 0
        last = np.maximum.accumulate(np.where(ok, place, -1))
        run = place - last + np.where(last < 0, carried, 0)
        if run[-1]:
            self.run.update((int(run[-1]),))
        else:
            self.run.clear()
        yield frame.loc[run == self.after, ["seq"]].assign(key=key[0])[["key", "seq"]]

    def close(self) -> None:
        pass


class RepeatWindow(StatefulProcessor):
    """The searches of a key that lie further than their adapter's horizon after the last one given out.

    The state is the time of that one; a timer takes it away when the watermark has passed the horizon.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f[["seq", "at", "hours"]] for f in rows]).sort_values(["at", "seq"])
        last = self.last.get()[0] if self.last.exists() else None
        keep = np.zeros(len(frame), bool)
        at, horizon = frame["at"].to_numpy(), frame["hours"].to_numpy() * 3_600_000_000
        begun, i = last, 0
        while i < len(at):
            keep[i] = last is None or horizon[i] == 0 or at[i] > last + horizon[i]
            if keep[i]:
                last = int(at[i])
            # on to the first search behind the horizon
            i += 1 if horizon[i] == 0 else max(1, int(np.searchsorted(at[i:], last + horizon[i], "right")))
        if last is not None and last != begun and horizon[-1]:
            self.last.update((last,))
            self.handle.registerTimer((last + int(horizon[-1])) // 1000 + 1)
        yield frame.loc[keep, ["seq"]].assign(adapter=key[0], key=key[1])[["adapter", "key", "seq"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # an older timer of a key that has a newer search leaves its state
        if self.last.exists() and not any(t > expiredTimerInfo.getExpiryTimeInMs() for t in self.handle.listTimers()):
            self.last.clear()
        yield pd.DataFrame({"adapter": pd.Series(dtype=str), "key": pd.Series(dtype=str), "seq": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def feed_cursors(entries: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """entries (source, guid, published long): those that are newer than all of their source in earlier batches, each guid once."""
    rows = entries.select("source", "guid", "published").filter("source is not null and guid is not null and published is not null")
    return rows.groupBy("source").transformWithStateInPandas(FeedCursor(idle_ms), "source string, guid string, published long", "Append", "ProcessingTime")


def failure_runs(events: DataFrame, after: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """events (key, at long, seq long, ok): the event at which a key's failures in a row reach after, each time they do."""
    rows = events.select("key", "at", "seq", F.coalesce("ok", F.lit(False)).alias("ok")).filter("key is not null")
    return rows.groupBy("key").transformWithStateInPandas(FailureRun(after, idle_ms), "key string, seq long", "Append", "ProcessingTime")


def fresh_searches(searches: DataFrame, adapters: DataFrame, delay: str = "1 hour") -> DataFrame:
    """searches (adapter, key, seq long, ts): those without an equal one given out within their adapter's repeat_after_hours.

    adapters (adapter, repeat_after_hours) is a bounded registry; 0 hours suppress nothing. What comes later than
    delay after newer searches is left out.
    """
    hours = F.broadcast(adapters.select("adapter", F.col("repeat_after_hours").cast("long").alias("hours")))
    rows = searches.filter("ts is not null and key is not null").withWatermark("ts", delay).join(hours, "adapter")
    rows = rows.select("adapter", "key", "seq", "ts", F.unix_micros("ts").alias("at"), "hours")
    return rows.groupBy("adapter", "key").transformWithStateInPandas(RepeatWindow(), "adapter string, key string, seq long", "Append", "EventTime")
