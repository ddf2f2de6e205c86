"""Queues and landings of the library, pages as they are landed, logs that are appended to, and metrics of a run; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import foundation, library, retrieval, sinks
from tessera.plans import core, curation
from tessera.plans.states import collector
from tessera.streaming.folders import shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = collector(QUERIES, ORACLE)

PAGE_TEXT = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?i)</(p|div|h[1-6]|li|tr|section)>', chr(10) || chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
)


@query(
    "ing01_page_text",
    rf"WITH p AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace({PAGE_TEXT}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '\r\n?', chr(10), 'g') AS t FROM pages) SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM p",
)
def _(t):
    text = X.page_text(F.col("html"))
    return t("pages", "page_id", "html").select("page_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


@query("snk01_upsert_order", "SELECT o_custkey AS k, CAST(o_orderkey AS DOUBLE) AS v, o_orderdate AS at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 UNION ALL SELECT c_custkey, c_acctbal, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    target = t("customer", "c_custkey AS k", "c_acctbal AS v")
    return sinks.upsert(target, t("orders", "o_custkey AS k", "cast(o_orderkey AS double) AS v", "o_orderdate AS at"), ["k"], ["at"])


@query("snk03_log_twice", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_id) AS kept, CAST(sum(value) * 100 AS BIGINT) AS cents FROM (SELECT * FROM events WHERE user_id % 3 = 0 UNION ALL SELECT * FROM events) GROUP BY 1")
def _(t):
    rows = t("events", "event_id", "user_id", "ts", "cast(value AS decimal(18,2)) AS value")
    folder = f"{shared_folder(rows.sparkSession)}/log"
    for part in (rows.filter("user_id % 3 = 0"), rows):
        sinks.append_log(part, folder, "ts")
    log = rows.sparkSession.read.schema("event_id long, value decimal(18,2), day date").parquet(folder)
    return log.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("kept"), (F.sum("value") * 100).cast("long").alias("cents"))


@query("knw04_extract_pending", "SELECT o_orderkey AS envelope_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderpriority < '3'")
def _(t):
    envelopes = t("orders", "o_orderkey AS envelope_id", "CASE o_orderstatus WHEN 'O' THEN 'NORMALIZED' ELSE 'RAW' END AS status", "o_custkey % 3 <> 0 AS extractable", "CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS duplicate_of", "o_orderpriority AS kind", "o_orderdate AS received_at")
    kinds = t("orders", "o_orderpriority AS kind", "CASE WHEN o_orderpriority < '3' THEN 'MODEL' ELSE 'RULES' END AS extractor").distinct()
    return foundation.extract_pending(envelopes, kinds).select("envelope_id")


@query(
    "knw07_assessed_claims",
    "SELECT p_partkey AS claim_id, p_brand AS topic, CASE WHEN p_size % 4 = 0 THEN 'No finding was stated.' ELSE p_name END AS finding, CASE p_size % 3 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'UNKNOWN' ELSE 'MODERATE' END AS confidence FROM part WHERE p_partkey % 2 = 0",
)
def _(t):
    findings = t("part", "p_partkey AS claim_id", "CASE WHEN p_size % 8 = 0 THEN '  ' WHEN p_size % 4 <> 0 THEN p_name END AS finding", "CASE p_size % 3 WHEN 0 THEN ' strong ' WHEN 1 THEN 'odd' ELSE 'Moderate' END AS confidence").filter("claim_id % 2 = 0")
    return foundation.apply_assessment(t("part", "p_partkey AS claim_id", "p_brand AS topic"), findings)


@query("knw21_negative_findings", "SELECT o_orderkey AS finding_id FROM orders WHERE o_custkey % 4 <> 0 AND o_orderkey % 3 <> 0 AND o_orderstatus <> 'P'")
def _(t):
    cols = ["CASE WHEN o_custkey % 4 = 0 THEN ' ' ELSE 'x' END AS claim_or_strategy", "CASE WHEN o_orderkey % 3 <> 0 THEN 'y' END AS why_investigated", "CASE o_orderstatus WHEN 'P' THEN '' ELSE 'e' END AS evidence_examined", "'f' AS finding", "o_orderpriority AS revisit_trigger"]
    return foundation.land_negative(t("orders", "o_orderkey AS finding_id", *cols)).select("finding_id")


@query("knw24_gap_assess_queue", "SELECT c_nationkey AS domain_key, count(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal < 0) AS dimensions_covered FROM customer GROUP BY 1 HAVING c_nationkey % 4 <> 0 AND count(DISTINCT c_mktsegment) FILTER (WHERE c_acctbal < 0) > 0")
def _(t):
    covered = t("customer", "c_nationkey AS domain_key", "CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS segment").groupBy("domain_key").agg(F.count_distinct("segment").alias("dimensions_covered"))
    return foundation.gap_assess_queue(covered.withColumn("gap_assessment_complete", F.col("domain_key") % 4 == 0)).drop("gap_assessment_complete")


@query(
    "cur02_heading_kinds",
    curation.LINES + "SELECT doc_id, ord, CASE WHEN level = 2 AND regexp_matches(heading, '(?i)^[a-m]') THEN 'PART' WHEN regexp_matches(heading, '(?i)card') THEN 'STRATEGY' WHEN regexp_matches(heading, '(?i)(?P<last>e)[.]$') THEN 'PRINCIPLE' ELSE 'REVIEW_REQUIRED' END AS block_kind FROM h",
)
def _(t):
    rules = [("1", "^[a-m]", "PART", 2, 10, True), ("2", "card", "STRATEGY", None, 20, True), ("3", "(?P<last>e)[.]$", "PRINCIPLE", None, 30, True), ("4", "", "IDLE", None, 1, False)]
    rules = t("documents").sparkSession.createDataFrame(rules, "rule_id string, pattern string, block_kind string, heading_level int, priority int, active boolean")
    blocks = library.heading_blocks(curation.curated_docs(t), "doc_id", "text")
    return library.classify_headings(blocks, rules).select("doc_id", "ord", "block_kind")


@query("ret15_run_metrics", core.PAGE + "SELECT a.*, CAST(20 AS INTEGER) AS cap, b.* FROM (SELECT count(*) AS hits, CAST(0 AS BIGINT) AS concept_hits, count(*) AS fts_hits, CAST(0 AS BIGINT) AS vector_hits FROM h) a, (SELECT count(*) AS shown, count(*) FILTER (WHERE deferred) AS deferred FROM page) b")
def _(t):
    hits = core.text_hits(lambda table: t(table, "*"))
    spark = hits.sparkSession
    _, metrics = retrieval.observed_page(hits, shared_folder(spark), 20, 1)
    names = ["hits", "concept_hits", "fts_hits", "vector_hits", "cap", "shown", "deferred"]
    return spark.createDataFrame([tuple(metrics[n] for n in names)], ", ".join(f"{n} {'int' if n == 'cap' else 'long'}" for n in names))
