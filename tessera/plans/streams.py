"""The streaming jobs over the events table, read as a stream; each query with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.library import PAUSE_AFTER
from tessera.streaming import jobs
from tessera.streaming.folders import shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a job of a stream of events; its batches land in the folder that all executors share."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
            events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
            return jobs.landed(f(events), shared_folder(spark))

        QUERIES[name], ORACLE[name] = run, sql
        return f

    return add


MICROS = "unix_micros(ts)"


@query("str02_feed", "SELECT event_type || '-' || CAST(user_id % 10 AS VARCHAR) AS source, CAST(event_id AS VARCHAR) AS guid, event_id AS published FROM events")
def _(events):
    source = F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string"))
    return jobs.feed_stream(events.select(source.alias("source"), F.col("event_id").cast("string").alias("guid"), F.col("event_id").alias("published")))


@query("str06_outcomes", "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, old_value, event_type AS value FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events) WHERE old_value IS DISTINCT FROM event_type")
def _(events):
    return jobs.outcome_stream(events.select(F.col("user_id").cast("string").alias("key"), F.expr(MICROS).alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("value")))


@query(
    "str07_pauses",
    f"WITH r AS (SELECT *, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), n AS (SELECT user_id, event_id, ok, row_number() OVER (PARTITION BY user_id, island, ok ORDER BY ts, event_id) AS run FROM r) SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq FROM n WHERE NOT ok AND run = {PAUSE_AFTER}",
)
def _(events):
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.expr(MICROS).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return jobs.pause_stream(rows, PAUSE_AFTER)


@query("str03_daily_spend", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY 1")
def _(events):
    return jobs.daily_spend(events.withColumn("value", F.col("value").cast("decimal(18,2)"))).select(F.col("day").cast("timestamp_ntz").alias("day"), "calls", F.col("spend").cast("double").alias("spend"))


@query("str08_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)")
def _(events):
    return jobs.sessions(events, "user_id").withColumn("started", F.col("started").cast("timestamp_ntz"))
