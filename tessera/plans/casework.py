"""Intake, sightings, claim phrases and case queries on the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import discovery, intake
from tessera.plans.states import collector

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = collector(QUERIES, ORACLE)

STATUSES = ["COMPLETED", "NOT_ASSESSED"]


def measured(t):
    """Payloads of measures and symptoms, some of them out of range or no numbers."""
    basic = "named_struct('height_cm', p_size * 10, 'weight_kg', if(p_size % 7 = 0, 'about 70', cast(p_retailprice / 4 AS string)))"
    symptoms = "named_struct('current_symptoms', array(named_struct('symptom', p_name, 'severity', p_size % 13)))"
    payload = f"to_json(named_struct('measured_on', if(p_size % 3 = 0, '03/04/2026', '2026-04-03'), 'sections', named_struct('BASIC_PROFILE', {basic}, 'SYMPTOMS', {symptoms})))"
    return t("part", "p_partkey AS submission_id", f"{payload} AS raw_payload")


HEIGHT, WEIGHT = "p_size * 10 BETWEEN 50 AND 260", "(p_size % 7 <> 0 AND p_retailprice / 4 BETWEEN 2 AND 400)"


@query(
    "cas01_value_checks",
    "SELECT submission_id, field_path, 'TREATED_AS_UNKNOWN' AS action FROM (SELECT p_partkey AS submission_id, 'measured_on' AS field_path FROM part WHERE p_size % 3 = 0 "
    f"UNION ALL SELECT p_partkey, 'BASIC_PROFILE.height_cm' FROM part WHERE NOT {HEIGHT} UNION ALL SELECT p_partkey, 'BASIC_PROFILE.weight_kg' FROM part WHERE NOT {WEIGHT} "
    "UNION ALL SELECT p_partkey, 'SYMPTOMS.current_symptoms[0].severity' FROM part WHERE p_size % 13 > 10)",
)
def _(t):
    return intake.check_values(measured(t), intake.SECTIONS, STATUSES).select("submission_id", "field_path", "action")


@query(
    "cas02_sanitize",
    f"SELECT p_partkey AS submission_id, CASE WHEN {HEIGHT} THEN CAST(p_size * 10 AS DOUBLE) END AS height_cm, CASE WHEN {WEIGHT} THEN p_retailprice / 4 END AS weight_kg, "
    "p_size % 3 <> 0 AS dated, CASE WHEN p_size % 13 <= 10 THEN CAST(p_size % 13 AS INTEGER) END AS severity FROM part",
)
def _(t):
    clean = intake.sanitize(measured(t), STATUSES)
    return clean.select("submission_id", "height_cm", "weight_kg", F.col("measured_on").isNotNull().alias("dated"), F.col("current_symptoms")[0]["severity"].alias("severity"))


@query(
    "cas04_measurements",
    f"SELECT p_partkey AS client_id, 'height_cm' AS measure, CAST(p_size * 10 AS DOUBLE) AS value, 'cm' AS unit FROM part WHERE {HEIGHT} UNION ALL SELECT p_partkey, 'weight_kg', p_retailprice / 4, 'kg' FROM part WHERE {WEIGHT}",
)
def _(t):
    clean = intake.sanitize(measured(t).withColumnRenamed("submission_id", "client_id"), STATUSES)
    return intake.extract(clean)["measurements"].select("client_id", "measure", "value", "unit")


def asked(t):
    goals = "named_struct('asia', if(p_size > 25, 'x', ''), 'brand', p_brand)"
    return t("part", "p_partkey AS submission_id", f"to_json(named_struct('sections', named_struct('GOALS', {goals}))) AS raw_payload")


def gaps(t):
    catalog = t(
        "region", "lower(r_name) AS field_key", "'GOALS' AS section", "r_name AS classification", "if(r_name = 'EUROPE', 'brand', NULL) AS condition_field",
        "array('brand#11', 'Brand#22') AS condition_values", "r_name = 'AMERICA' AS rht_owned", "true AS active",
    )
    return intake.validate(asked(t), catalog, {"ASIA": "HIGH"})


GAPS = "SELECT p_partkey AS submission_id, lower(r_name) AS missing_field, CASE r_name WHEN 'ASIA' THEN 'HIGH' ELSE 'MODERATE' END AS severity FROM part, region WHERE r_name <> 'AMERICA' AND NOT (r_name = 'ASIA' AND p_size > 25) AND (r_name <> 'EUROPE' OR upper(p_brand) IN ('BRAND#11', 'BRAND#22'))"


@query("cas03_completeness_gaps", GAPS)
def _(t):
    return gaps(t).select("submission_id", "missing_field", "severity")


@query(
    "cas05_canonical_state",
    f"WITH g AS ({GAPS}) SELECT submission_id, count(*) AS n_gaps, coalesce(string_agg(missing_field, ',') FILTER (WHERE severity = 'HIGH'), '') AS high_priority, 0 AS n_unusable, 'UNKNOWN' AS symptoms FROM g GROUP BY 1",
)
def _(t):
    out = intake.canonical_state(asked(t), gaps(t), intake.SECTIONS, STATUSES)
    return out.select("submission_id", "n_gaps", F.array_join("high_priority", ",").alias("high_priority"), F.size("unusable").alias("n_unusable"), F.col("sections")["SYMPTOMS"].alias("symptoms"))


@query(
    "ing08_identify_items",
    "SELECT event_id, coalesce(a.c_custkey, b.c_custkey) AS item_id FROM events LEFT JOIN customer a ON event_type = 'view' AND a.c_custkey = user_id LEFT JOIN customer b ON b.c_custkey = user_id - 1",
)
def _(t):
    new = t("events", "event_id", "(user_id - 1) % 5 AS source_id", "if(event_type = 'view', concat('u', user_id), NULL) AS url", "cast(user_id AS string) AS guid")
    items = t("customer", "c_custkey AS item_id", "c_custkey % 5 AS source_id", "concat('u', c_custkey) AS url", "cast(c_custkey + 1 AS string) AS external_id")
    return discovery.identify_items(new, items).select("event_id", "item_id")


PHRASES = "(SELECT l_orderkey AS e, p, CASE WHEN count(DISTINCT f) = 1 THEN min(f) END AS f FROM (SELECT l_orderkey, 'target' AS f, l_returnflag AS p FROM lineitem UNION ALL SELECT l_orderkey, 'intervention', CASE WHEN l_quantity > 25 THEN l_linestatus ELSE 'R' END FROM lineitem) GROUP BY 1, 2)"


@query(
    "knw02_claim_concepts",
    f"SELECT e AS envelope_id, count(*) AS seen, count(CASE WHEN f = 'target' THEN 1 END) AS known, count(CASE WHEN f IS NULL OR f <> 'target' THEN 1 END) AS new FROM {PHRASES} GROUP BY 1",
)
def _(t):
    cards = t("lineitem", "l_orderkey AS envelope_id", "concat(' ', l_returnflag) AS target", "if(l_quantity > 25, l_linestatus, 'R') AS intervention")
    phrases = discovery.claim_phrases(cards, ["target", "intervention"])
    return discovery.claim_census(phrases, phrases.filter("field = 'target'"))


def big_parts(t):
    return t("part", "p_brand AS query_id", "p_partkey AS concept_id", "p_size").filter("p_size > 40").drop("p_size")


@query(
    "ret03_by_concept_patterns",
    "SELECT p_brand AS query_id, o_custkey AS id, l_partkey AS bucket, max(l_quantity) AS raw, CASE WHEN o_totalprice > 100000 THEN o_orderpriority ELSE 'pattern' END AS label FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size > 40 AND o_orderstatus <> 'F' GROUP BY 1, 2, 3, 5",
)
def _(t):
    patterns = t("orders", "o_custkey AS pattern_id", "o_orderkey AS strategy_id", "if(o_totalprice > 100000, o_orderpriority, NULL) AS intervention", "cast(NULL AS string) AS practical_method")
    links = t("lineitem", "l_orderkey AS strategy_id", "l_partkey AS concept_id", "l_quantity AS weight")
    strategies = t("orders", "o_orderkey AS strategy_id", "if(o_orderstatus = 'F', 'DEPRECATED', 'SUPPORTED') AS knowledge_status")
    return discovery.by_concept_patterns(big_parts(t), patterns, links, strategies).select("query_id", "id", "bucket", "raw", "label")


@query(
    "ret04_by_concept_curated",
    "SELECT p_brand AS query_id, l_suppkey AS id, l_partkey AS bucket, max(l_quantity) AS raw, s_name AS label FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size > 40 GROUP BY 1, 2, 3, 5",
)
def _(t):
    links = t("lineitem", "l_suppkey AS curated_id", "l_partkey AS concept_id", "l_quantity AS weight")
    return discovery.by_concept_curated(big_parts(t), links, t("supplier", "s_suppkey AS curated_id", "s_name AS name")).select("query_id", "id", "bucket", "raw", "label")


@query(
    "ret19_case_queries",
    "SELECT o_orderkey AS case_id, o_orderstatus || ' ' || o_orderpriority || CASE WHEN o_totalprice > 100000 THEN ' why' ELSE '' END AS query_text, coalesce(c, '') AS concepts FROM orders LEFT JOIN (SELECT n_name, string_agg(DISTINCT CAST(n_regionkey AS VARCHAR), ',') AS c FROM nation GROUP BY 1) ON n_name = o_orderpriority",
)
def _(t):
    controls = t("orders", "o_orderkey AS case_id", "array(o_orderstatus, o_orderpriority) AS phrases", "if(o_totalprice > 100000, array('why'), NULL) AS questions")
    resolutions = t("nation", "n_name AS phrase", "array(cast(n_regionkey AS string)) AS concept_ids")
    return discovery.case_queries(controls, resolutions).select("case_id", "query_text", F.array_join("concept_ids", ",").alias("concepts"))
