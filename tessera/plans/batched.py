"""Streams over several batches, each carrying its state or its tables on; each query with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.library import PAUSE_AFTER
from tessera.plans.core import PACKED
from tessera.streaming import jobs, stateful, tables
from tessera.streaming.folders import in_batches, shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BATCHES = 3


def query(name: str, sql: str):
    """Register a function of (t, folder, ) where t(name) reads a table and folder is the stream's own."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), shared_folder(spark))

        QUERIES[name], ORACLE[name] = run, sql
        return f

    return add


#: The batch of an event: by day, and some days late for every eleventh.
UNORDERED = f"CASE WHEN event_id % 11 = 0 THEN {BATCHES - 1} ELSE least({BATCHES - 1}, (day(ts) - 1) // 10) END"


def events(t, late: bool = False) -> DataFrame:
    rows = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.least(F.lit(BATCHES - 1), F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int")
    return rows.withColumn("b", F.when(F.col("event_id") % 11 == 0, F.lit(BATCHES - 1)).otherwise(day) if late else day)


def stateful_batches(rows: DataFrame, folder: str, job) -> DataFrame:
    """What a stateful job gives out over all batches."""
    found = []
    with stateful.rocksdb(rows.sparkSession):
        in_batches(rows, "b", BATCHES, folder, lambda stream: found.append(jobs.landed(job(stream), f"{folder}/out")))
    return found[-1]


def table_batches(rows: DataFrame, folder: str, write) -> None:
    in_batches(rows, "b", BATCHES, folder, lambda stream: tables.run(stream, f"{folder}/out", write))


FEED = "CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 3 AS BIGINT) ELSE event_id * 3 // (SELECT max(event_id) + 1 FROM events) END"


@query(
    "str02_feed_cursors",
    f"WITH e AS (SELECT event_type || '-' || CAST(user_id % 10 AS VARCHAR) AS source, CAST(event_id // 40 AS VARCHAR) AS guid, event_id AS published, {FEED} AS b FROM events), "
    "m AS (SELECT source, b, max(published) AS top FROM e GROUP BY 1, 2), c AS (SELECT e.source, e.b, max(m.top) AS seen FROM (SELECT DISTINCT source, b FROM e) e JOIN m ON m.source = e.source AND m.b < e.b GROUP BY 1, 2), "
    "n AS (SELECT e.*, row_number() OVER (PARTITION BY source, guid ORDER BY b, published) AS rn FROM e LEFT JOIN c USING (source, b) WHERE published > coalesce(seen, -1)) SELECT source, guid, published FROM n WHERE rn = 1",
)
def _(t, folder):
    rows = t("events").crossJoin(F.broadcast(t("events").agg((F.max("event_id") + 1).alias("n"))))
    number = F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 3).otherwise(F.floor(F.col("event_id") * 3 / F.col("n"))).cast("int")
    source = F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string"))
    rows = rows.select(source.alias("source"), F.floor(F.col("event_id") / 40).cast("string").alias("guid"), F.col("event_id").alias("published"), number.alias("b"))
    return stateful_batches(rows, folder, stateful.feed_cursors)


RUNS = f"WITH r AS (SELECT *, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), n AS (SELECT user_id, event_id, ok, row_number() OVER (PARTITION BY user_id, island, ok ORDER BY ts, event_id) AS run FROM r) SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq FROM n WHERE NOT ok AND run = {PAUSE_AFTER}"


@query("str07_failure_runs", RUNS)
def _(t, folder):
    rows = events(t).select(F.col("user_id").cast("string").alias("key"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), "b")
    return stateful_batches(rows, folder, lambda stream: stateful.failure_runs(stream, PAUSE_AFTER))


@query(
    "str05_fresh_searches",
    "WITH RECURSIVE s AS (SELECT user_id, event_id, ts, CASE user_id % 2 WHEN 1 THEN 72 ELSE 240 END AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), "
    "r AS (SELECT user_id, event_id, rn, ts AS last, true AS fresh FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.event_id, s.rn, CASE WHEN s.ts > r.last + to_hours(s.h) THEN s.ts ELSE r.last END, s.ts > r.last + to_hours(s.h) FROM s JOIN r ON r.user_id = s.user_id AND s.rn = r.rn + 1) "
    "SELECT CASE user_id % 2 WHEN 1 THEN 'p' ELSE 'q' END AS adapter, CAST(user_id AS VARCHAR) AS key, event_id AS seq FROM r WHERE fresh",
)
def _(t, folder):
    rows = events(t).select(F.when(F.col("user_id") % 2 == 1, "p").otherwise("q").alias("adapter"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts", "b")
    adapters = t("region").select(F.when(F.col("r_regionkey") == 0, "p").otherwise("q").alias("adapter"), F.when(F.col("r_regionkey") == 0, 72).otherwise(240).alias("repeat_after_hours")).distinct()
    return stateful_batches(rows, folder, lambda stream: stateful.fresh_searches(stream, adapters))


@query("str06_outcome_table", "SELECT user_id AS key, event_id AS seq, event_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(t, folder):
    rows = events(t, late=True).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), "b")
    kept = "key long, at timestamp, seq long, value string"
    table_batches(rows, folder, tables.upsert_writer(f"{folder}/out", kept, ["key"], ["at", "seq"]))
    return tables.upserted(rows.sparkSession, f"{folder}/out", kept).select("key", "seq", "value")


@query(
    "str01_inbox_store",
    f"WITH packed AS ({PACKED}), f AS (SELECT doc_id, sha256(replace(text, chr(10), chr(10) || chr(10))) AS sha256, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3, CAST(doc_id AS VARCHAR)) AS rn FROM documents WHERE text IS NOT NULL) "
    "SELECT CAST(doc_id AS VARCHAR) AS path, sha256, chunk_index, n_chars FROM f JOIN packed USING (doc_id) WHERE rn = 1",
)
def _(t, folder):
    text = F.regexp_replace("text", "\n", "\n\n")
    rows = t("documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.sha2(text, 256).alias("sha256"), text.alias("text"), (F.col("doc_id") % 3).cast("int").alias("b"))
    table_batches(rows, folder, tables.inbox_writer(f"{folder}/out"))
    return tables.stored_chunks(rows.sparkSession, f"{folder}/out").select("path", "sha256", "chunk_index", F.length("chunk").alias("n_chars"))


#: What each batch of events counts in a window, in time or late: e (start, stop, b, ts, v) -> rows of the ledger.
LEDGER = (
    "m AS (SELECT b, max(ts) AS newest FROM e GROUP BY 1), k AS (SELECT a.b, max(m.newest) AS newest FROM (SELECT DISTINCT b FROM e) a JOIN m ON m.b < a.b GROUP BY 1), "
    "l AS (SELECT e.*, coalesce(stop <= newest - INTERVAL {0} DAY, false) AS late FROM e LEFT JOIN k USING (b)) "
    "SELECT start, count(*) FILTER (WHERE NOT late) AS n, CAST(coalesce(sum(v) FILTER (WHERE NOT late), 0) AS DOUBLE) AS total, count(*) FILTER (WHERE late) AS late_n, CAST(coalesce(sum(v) FILTER (WHERE late), 0) AS DOUBLE) AS late_total FROM l GROUP BY 1"
)


def told(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("total").cast("double").alias("total"), "late_n", F.col("late_total").cast("double").alias("late_total"))


@query("str03_spend_ledger", f"WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS stop, {UNORDERED} AS b, ts, CAST(value AS DECIMAL(18,2)) AS v FROM events), " + LEDGER.format(1))
def _(t, folder):
    rows = events(t, late=True).select("ts", F.col("value").cast("decimal(18,2)").alias("value"), "b")
    table_batches(rows, folder, tables.ledger_writer(f"{folder}/out", "ts", "value", "1 day", "1 day", "1 DAY"))
    return told(tables.ledger(rows.sparkSession, f"{folder}/out"))


@query(
    "str04_escalation_ledger",
    f"WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP - to_days(d) AS start, date_trunc('day', ts)::TIMESTAMP - to_days(d) + INTERVAL 7 DAY AS stop, {UNORDERED} AS b, ts, 1 AS v FROM events, (SELECT unnest(range(7))::INT AS d) WHERE event_type = 'error'), " + LEDGER.format(2),
)
def _(t, folder):
    rows = events(t, late=True).filter("event_type = 'error'").select("ts", F.lit(1).alias("one"), "b")
    table_batches(rows, folder, tables.ledger_writer(f"{folder}/out", "ts", "one", "7 days", "1 day", "2 DAYS"))
    return told(tables.ledger(rows.sparkSession, f"{folder}/out"))
