"""Structured Streaming forms of the append-only logs; each is the batch operator over a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators.ingest import chunk_sections


def inbox_stream(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """New files with the hash of their bytes; retries within the watermark are dropped, as are files whose hash the store knows (sha256)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    out = files.select("path", F.col("modificationTime").alias("landed_at"), F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    out = out.withWatermark("landed_at", "1 day").dropDuplicatesWithinWatermark(["sha256"])
    return out if known is None else out.join(known.select("sha256"), "sha256", "left_anti")


def inbox_chunks(inbox: DataFrame) -> DataFrame:
    """The chunks of the files of an inbox stream."""
    return chunk_sections(inbox.select("path", "sha256", F.col("text").alias("body")))


def daily_spend(events: DataFrame, at: str = "ts", value: str = "value") -> DataFrame:
    rows = events.withWatermark(at, "1 day").groupBy(F.window(at, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(value), 4).alias("spend"))
    return rows.select(F.col("w.start").alias("day"), "calls", "spend")


def trailing_counts(events: DataFrame, at: str, kind: str) -> DataFrame:
    """Events of a kind in each trailing seven days, by day."""
    rows = events.withWatermark(at, "7 days").filter(F.col("event_type") == kind)
    return rows.groupBy(F.window(at, "7 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.end").alias("until"), "n")


def repeat_suppression(searches: DataFrame, at: str, key: str, horizon: str) -> DataFrame:
    return searches.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, user: str, at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    rows = events.withWatermark(at, gap).groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(user, F.col("w.start").alias("started"), "n")


def _state(rows: DataFrame, keys: list[str], out: str, state: str, first: tuple, step) -> DataFrame:
    """step(state, rows of a key as a frame) -> (state, frame of rows to give out), for each key and batch."""

    def run(key, batches, held):
        now = held.get if held.exists else first
        frame = pd.concat(list(batches))
        now, given = step(now, frame)
        held.update(now)
        if len(given):
            yield given

    return rows.groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def feed_stream(entries: DataFrame) -> DataFrame:
    """entries (source, guid, published long): those after the last one seen of their source, oldest first.

    The cursor of a source is its newest (published, guid); what comes late or again is left out.
    """

    def step(now, frame):
        frame = frame.drop_duplicates("guid").sort_values(["published", "guid"])
        fresh = frame[[(p, g) > now for p, g in zip(frame["published"], frame["guid"], strict=True)]]
        if len(fresh):
            now = (int(fresh["published"].iloc[-1]), str(fresh["guid"].iloc[-1]))
        return now, fresh[["source", "guid", "published"]]

    return _state(entries.select("source", "guid", "published"), ["source"], "source string, guid string, published long", "published long, guid string", (-(2**62), ""), step)


def outcome_stream(events: DataFrame) -> DataFrame:
    """events (key, at long, seq long, value): each change of a key's value with the value before it; repeats are left out.

    The state of a key is its latest value; events are in order between batches.
    """

    def step(now, frame):
        frame = frame.sort_values(["at", "seq"])
        before = [now[0] if now[1] else None, *frame["value"].iloc[:-1]]
        frame = frame.assign(old_value=before)
        changed = frame[[o != v for o, v in zip(frame["old_value"], frame["value"], strict=True)]]
        return (str(frame["value"].iloc[-1]), True), changed[["key", "seq", "old_value", "value"]]

    return _state(events.select("key", "at", "seq", "value"), ["key"], "key string, seq long, old_value string, value string", "value string, seen boolean", ("", False), step)


def pause_stream(events: DataFrame, after: int) -> DataFrame:
    """events (key, at long, seq long, ok): the event at which a key's failures in a row reach after, each time they do.

    The state of a key is how many of its last events failed, so a run of failures may cross batches.
    """

    def step(now, frame):
        frame, run, hits = frame.sort_values(["at", "seq"]), now[0], []
        for ok in frame["ok"]:
            run = 0 if ok else run + 1
            hits.append(run == after)
        return (run,), frame[hits][["key", "seq"]]

    return _state(events.select("key", "at", "seq", "ok"), ["key"], "key string, seq long", "run int", (0,), step)


def landed(df: DataFrame, folder: str) -> DataFrame:
    """Process what there is; each batch is a folder of its own, written anew if it is run again, and all are read."""

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/batch=*")


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what there is into a memory table (tests and small reports)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
