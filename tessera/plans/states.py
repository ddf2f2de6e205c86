"""Follow-up, evaluation and foundation operators on the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import followup, foundation

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def collector(queries: dict, oracle: dict[str, str]):
    """A decorator that registers a function of a table reader as a query beside its SQL."""

    def query(name: str, sql: str):
        def add(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda table, *columns: spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns))

            queries[name], oracle[name] = run, sql
            return f

        return add

    return query


query = collector(QUERIES, ORACLE)


STATUS = "CASE o_orderstatus WHEN 'O' THEN 'ONGOING' WHEN 'F' THEN 'COMPLETED' ELSE 'PROPOSED' END"


def clients(t):
    return t("customer", "c_custkey AS client_id", "c_name AS display_name")


def interventions(t):
    return t("orders", "o_custkey AS client_id", "o_orderkey AS intervention_id", "o_orderpriority AS name", f"{STATUS} AS status")


def history(t):
    return t("lineitem", "l_orderkey AS intervention_id", "l_shipdate AS recorded_at")


@query(
    "cas06_intake_completeness",
    "WITH s AS (SELECT l_orderkey AS o, count(DISTINCT l_suppkey) AS p, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS na, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS g, count(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'A' THEN 1 END) AS h FROM lineitem GROUP BY 1) "
    "SELECT o_orderkey AS submission_id, coalesce(p, 0) AS sections_present, coalesce(na, 0) AS sections_not_applicable, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS sections_defined, coalesce(g, 0) AS open_gaps, coalesce(h, 0) AS high_priority_gaps FROM orders LEFT JOIN s ON o = o_orderkey",
)
def _(t):
    sections = t("lineitem", "l_orderkey AS submission_id", "l_suppkey AS section", "l_returnflag = 'R' AS not_applicable")
    reports = t("lineitem", "l_orderkey AS submission_id", "l_linestatus = 'F' AS resolved", "CASE l_returnflag WHEN 'A' THEN 'LOW' WHEN 'R' THEN 'HIGH' ELSE 'CRITICAL' END AS severity")
    catalog = t("supplier", "s_suppkey AS section", "true AS active", "s_acctbal <= 0 AS rht_owned")
    return followup.intake_completeness(t("orders", "o_orderkey AS submission_id"), sections, reports, catalog)


@query(
    "cas07_missing_recurrence",
    "SELECT event_type AS missing_field, count(*) AS reports, count(DISTINCT user_id) AS distinct_clients, count(CASE WHEN value > 100 THEN 1 END) AS constrained_reasoning_count, array_to_string(list_sort(list(DISTINCT CASE WHEN value > 150 THEN 'E' || CAST(user_id % 7 AS VARCHAR) END) FILTER (WHERE value > 150)), ',') AS engines, "
    "count(CASE WHEN value > 150 THEN 1 END) AS engine_reports, count(CASE WHEN value <= 150 THEN 1 END) AS intake_reports, max(CASE WHEN value > 100 THEN 'LOW' ELSE 'HIGH' END) AS max_severity, min(event_type) AS classification FROM events GROUP BY event_type",
)
def _(t):
    rows = t(
        "events", "event_type AS missing_field", "user_id AS client_id", "value > 100 AS constrained_reasoning", "CASE WHEN value > 150 THEN concat('E', user_id % 7) END AS engine",
        "CASE WHEN value <= 150 THEN event_id END AS submission_id", "CASE WHEN value > 100 THEN 'LOW' ELSE 'HIGH' END AS severity", "event_type AS classification",
    )
    return followup.missing_recurrence(rows).withColumn("engines", F.array_join("engines", ","))


@query(
    "cas09_assessment_package",
    "WITH l AS (SELECT l_orderkey AS o, l_returnflag AS k, arg_max(l_quantity, (l_linenumber, l_partkey, l_quantity)) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT o, string_agg(k || '=' || CAST(CAST(q AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS layers, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1) "
    "SELECT o_orderkey AS assessment_id, coalesce(layers, '') AS layers, coalesce(n, 0) AS layer_count FROM orders LEFT JOIN p ON o = o_orderkey",
)
def _(t):
    layers = t("lineitem", "l_orderkey AS assessment_id", "l_returnflag AS layer_type", "cast(l_quantity AS bigint) AS payload", "l_linenumber * 1000000000000 + l_partkey * 1000 + cast(l_quantity AS bigint) AS layer_id")
    out = followup.assessment_package(t("orders", "o_orderkey AS assessment_id"), layers)
    each = F.transform(F.array_sort(F.map_entries(F.coalesce("layers", F.expr("cast(map() AS map<string,bigint>)")))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("assessment_id", F.array_join(each, ",").alias("layers"), "layer_count")


@query(
    "cas10_assessment_status",
    "SELECT c_custkey AS client_id, coalesce(s, 'NOT_ASSESSED') AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey",
)
def _(t):
    rows = t("orders", "o_custkey AS client_id", "o_orderkey AS assessment_id", "o_orderdate AS assessed_on", "o_orderpriority AS instrument", "o_orderstatus AS status")
    return followup.assessment_status(clients(t), rows, "1-URGENT")


@query(
    "cas15_plan_items",
    "SELECT conv_id AS client_id, left(trim(text), 200) AS name, CASE WHEN role = 'user' THEN 'PRIMARY' ELSE 'SUPPORTIVE' END AS tier, role AS purpose, 'PROPOSED' AS status FROM conversations WHERE trim(text) <> ''",
)
def _(t):
    rows = t("conversations", "conv_id AS client_id", "to_json(array(named_struct('name', text, 'tier', if(role = 'user', 'primary', role), 'purpose', role))) AS items")
    return followup.land_plan_items(rows)[0]


@query(
    "cas16_followup_queue",
    "WITH i AS (SELECT o_custkey AS c, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS n, arg_max(o_orderkey % 5, (o_orderdate, o_orderkey)) AS hops FROM orders GROUP BY 1) SELECT event_id AS followup_id, user_id AS client_id, coalesce(n, 0) AS live_interventions, CAST(hops AS BIGINT) AS last_cycle_hops FROM events JOIN customer ON c_custkey = user_id LEFT JOIN i ON c = user_id WHERE event_type = 'error'",
)
def _(t):
    rows = t("events", "event_id AS followup_id", "user_id AS client_id", "ts AS submitted_on", "if(event_type = 'error', NULL, ts) AS processed_at")
    cycles = t("orders", "o_custkey AS client_id", "o_orderkey AS cycle_id", "o_orderdate AS opened_at", "o_orderkey % 5 AS loop_count", "5 AS max_loops")
    return followup.followup_queue(rows, clients(t), interventions(t), cycles).select("followup_id", "client_id", "live_interventions", "last_cycle_hops")


RESPONSE = "SELECT o_orderkey AS intervention_id, coalesce(n, 0) AS times_assessed, seen AS last_assessed_at, n IS NULL AS never_assessed FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS seen FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


@query("cas17_live_interventions", RESPONSE + " WHERE o_orderstatus <> 'F'")
def _(t):
    return followup.live_interventions(interventions(t), history(t)).select("intervention_id", "times_assessed", "last_assessed_at", "never_assessed")


@query("cas20_intervention_response", RESPONSE)
def _(t):
    return followup.intervention_response(interventions(t), history(t)).select("intervention_id", "times_assessed", "last_assessed_at", "never_assessed")


@query(
    "cas18_land_outcomes",
    "WITH live AS (SELECT o_custkey AS c, o_orderpriority AS p, max(o_orderkey) AS i, arg_max(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) "
    "SELECT c AS client_id, i AS intervention_id, CASE event_type WHEN 'error' THEN 'WORSENING' ELSE 'NOT_TRACKED' END AS outcome, CASE WHEN value > 100 THEN 'STOPPED' WHEN s = 'O' THEN 'ONGOING' ELSE 'PROPOSED' END AS status FROM events JOIN live ON c = user_id AND p = '3-MEDIUM'",
)
def _(t):
    item = "named_struct('name', ' 3-Medium ', 'outcome', if(event_type = 'error', 'worsening', event_type), 'status', if(value > 100, 'stopped', 'other'))"
    return followup.land_outcomes(t("events", "user_id AS client_id", f"to_json(array({item})) AS outcomes"), interventions(t))[0]


@query("cas32_fact_audit", "SELECT event_id, CASE WHEN value > 100 AND (event_type = 'view' OR user_id % 3 = 0) THEN 'APPROVED_WITHOUT_AUTHORITY' ELSE 'CONFIDENCE_RANGE' END AS violation FROM events WHERE value > 100 AND (event_type = 'view' OR user_id % 3 = 0) OR value / 200 > 1")
def _(t):
    rows = t(
        "events", "event_id", "if(value > 100, 'APPROVED', 'PENDING') AS status", "if(event_type = 'view', NULL, event_type) AS authorization_type",
        "if(user_id % 3 = 0, ' ', 'reviewer') AS approved_by", "value / 200 AS extraction_confidence",
    )
    return followup.audit_facts(rows).select("event_id", "violation")


def concepts(t):
    return t("part", "p_partkey AS concept_id", "p_name AS name", "lpad(cast(p_partkey AS string), 9, '0') AS canonical_key", "if(p_size > 40, 'DEPRECATED', 'ACTIVE') AS status")


def concept_domains(t):
    return t("part", "p_partkey AS concept_id", "p_brand AS domain_id")


def domains(t):
    return concept_domains(t).select("domain_id", F.col("domain_id").alias("name")).distinct()


FAMILY = "WITH m AS (SELECT p_brand AS b, p_partkey AS k, p_name AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part WHERE p_size <= 40) "


@query(
    "evl01_generate_a",
    FAMILY + "SELECT b AS domain_id, b || ': ' || string_agg(n, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS query_text, string_agg(CAST(k AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r > 3) AS expected FROM m WHERE c >= 8 GROUP BY b",
)
def _(t):
    return foundation.generate_a(concept_domains(t), concepts(t), domains(t)).select("domain_id", "query_text", F.array_join("expected", ",").alias("expected"))


@query(
    "evl02_generate_b",
    "WITH k AS (SELECT conv_id, turn, text, role FROM conversations), f AS (SELECT conv_id, role, min(turn) AS a FROM k GROUP BY 1, 2), e AS (SELECT conv_id, string_agg(role, ',' ORDER BY a, role) AS expected FROM f GROUP BY 1) "
    "SELECT k.conv_id AS item_id, 'held-out source: ' || left(string_agg(text, ' ' ORDER BY turn, text), 900) AS query_text, any_value(expected) AS expected FROM k JOIN e USING (conv_id) GROUP BY 1",
)
def _(t):
    keys = t("conversations", "conv_id AS item_id", "turn AS extracted_at", "text AS key_id", "text AS claim_text", "array(role) AS concept_ids")
    items = t("conversations", "conv_id AS item_id").distinct().select("item_id", F.lit("").alias("title"), F.lit(True).alias("held_out"))
    return foundation.generate_b(items, keys).select("item_id", "query_text", F.array_join("expected", ",").alias("expected"))


@query("evl03_generate_c", FAMILY + "SELECT b AS domain_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY r) AS query_concepts FROM m WHERE r <= 6 AND b IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(CASE WHEN p_retailprice > 950 THEN 1 END) >= 6) GROUP BY b")
def _(t):
    coverage = t("part", "p_brand AS domain_id", "p_retailprice > 950 AS covered")
    return foundation.generate_c(coverage, concept_domains(t), concepts(t)).select("domain_id", F.array_join("query_concepts", ",").alias("query_concepts"))


@query(
    "evl10_evaluation_state",
    "SELECT layer, coalesce(n, 0) AS tests_defined, run_id FROM (VALUES ('A'), ('B'), ('C')) AS l(layer) LEFT JOIN (SELECT left(upper(event_type), 1) AS e, arg_max(event_id, (ts, event_id)) AS run_id FROM events WHERE value > 10 GROUP BY 1) ON e = layer LEFT JOIN (SELECT left(p_type, 1) AS p, count(*) AS n FROM part GROUP BY 1) ON p = layer",
)
def _(t):
    runs = t("events", "left(upper(event_type), 1) AS layer", "event_id AS run_id", "ts AS started_at", "if(value > 10, ts, NULL) AS finished_at", "1 AS tests_run", "1 AS tests_passed", "value AS mean_score")
    return foundation.evaluation_state(runs, t("part", "left(p_type, 1) AS layer", "true AS active")).select("layer", "tests_defined", "run_id")


@query("ont09_escalation_queue", "SELECT l_orderkey AS proposal_id, l_linenumber AS n, p_name AS nearest_concept FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40 WHERE l_returnflag = 'R'")
def _(t):
    rows = t("lineitem", "l_orderkey AS proposal_id", "l_linenumber AS n", "l_partkey AS candidate_concept", "if(l_returnflag = 'R', 'ESCALATED', 'ACCEPTED') AS decision", "l_quantity AS impact_score", "l_shipdate AS created_at")
    c = t("part", "p_partkey AS concept_id", "p_name AS canonical_key", "p_size").filter("p_size <= 40")
    return foundation.escalation_queue(rows, c).select("proposal_id", "n", "nearest_concept")


@query("ont10_needs_type_queue", "SELECT l_orderkey AS proposal_id, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O'")
def _(t):
    rows = t("lineitem", "l_orderkey AS proposal_id", "l_linenumber AS n", "if(l_returnflag = 'N', 'NEEDS_TYPE', 'ACCEPTED') AS decision", "if(l_linestatus = 'O', NULL, l_shipdate) AS resolved_at", "l_quantity AS impact_score", "l_shipdate AS created_at")
    return foundation.needs_type_queue(rows).select("proposal_id", "n")


@query("knw14_retrieval_gaps", "SELECT o_orderkey AS strategy_id, 'HIGH' AS severity, 'OPEN' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderstatus <> 'F'")
def _(t):
    links = t("lineitem", "l_orderkey AS strategy_id", "l_returnflag").filter("l_returnflag = 'R'")
    gaps = t("orders", "o_orderkey AS strategy_id", "'RETRIEVAL' AS kind", "if(o_orderstatus = 'F', 'OPEN', 'CLOSED') AS status")
    return foundation.retrieval_gaps(t("orders", "o_orderkey AS strategy_id"), links, gaps).select("strategy_id", "severity", "status")


@query("knw17_escalate_gaps", "SELECT o_orderkey AS gap_id, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) THEN 'RESEARCHING' WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status FROM orders")
def _(t):
    gaps = t("orders", "o_orderkey AS gap_id", "if(o_orderstatus = 'O', 'OPEN', 'CLOSED') AS status", "o_totalprice")
    return foundation.escalate_gaps(gaps, [F.desc("o_totalprice")]).select("gap_id", "status")


@query(
    "knw19_domain_material",
    "SELECT domain_id, item_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY item_id) AS rank FROM (SELECT DISTINCT p_brand AS domain_id, l_orderkey AS item_id FROM part JOIN lineitem ON l_partkey = p_partkey)) WHERE rank <= 60",
)
def _(t):
    return foundation.domain_material(concept_domains(t), t("lineitem", "l_partkey AS concept_id", "l_orderkey AS item_id"))


@query(
    "knw20_controversies",
    "SELECT page_id AS controversy_id, CAST(i AS INTEGER) AS position_no, p[i + 1] AS position FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: trim(x) <> '') AS p FROM pages), range(0, 99) r(i) WHERE len(p) >= 2 AND i < len(p)",
)
def _(t):
    return foundation.land_controversies(t("pages", "page_id AS controversy_id", "url AS question", "split(url, '/') AS positions"))[1]


@query(
    "knw22_controversy_state",
    "WITH c AS (SELECT o_custkey AS d, count(*) AS n, CAST(coalesce(sum(p), 0) AS BIGINT) AS ps FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1), e AS (SELECT user_id AS d, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS v FROM events GROUP BY 1) "
    "SELECT c_custkey AS domain_id, coalesce(c.n, 0) AS controversies, coalesce(ps, 0) AS positions, coalesce(e.n, 0) AS negative_findings, c_acctbal > 0 AS pass_performed, c_acctbal <= 0 AND coalesce(v, 0) >= 6 AS overdue FROM customer LEFT JOIN c ON c.d = c_custkey LEFT JOIN e ON e.d = c_custkey",
)
def _(t):
    d = t("customer", "c_custkey AS domain_id", "true AS active")
    passes = t("customer", "c_custkey AS domain_id", "c_acctbal", "timestamp'2026-01-01' AS assessed_at").filter("c_acctbal > 0")
    c, p = t("orders", "o_orderkey AS controversy_id", "o_custkey AS domain_id"), t("lineitem", "l_orderkey AS controversy_id")
    out = foundation.controversy_state(d, passes, c, p, t("events", "user_id AS domain_id"), t("events", "user_id AS domain_id", "value > 50 AS covered"))
    return out.select("domain_id", "controversies", "positions", "negative_findings", "pass_performed", "overdue")


@query("knw28_evidence_without_claim", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-02' THEN 'PREDATES_LINK' ELSE 'INVESTIGATE' END AS why FROM events WHERE event_type = 'error'")
def _(t):
    return foundation.evidence_without_claim(t("events", "event_id", "ts AS created_at", "if(event_type = 'error', NULL, user_id) AS claim_id"), "2024-01-02").select("event_id", "why")


@query("knw30_asr_claims", "SELECT DISTINCT l_orderkey AS claim_id, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
def _(t):
    claims = t("lineitem", "l_orderkey AS claim_id", "l_linenumber", "l_orderkey AS envelope_id")
    out = foundation.asr_claims(claims, t("orders", "o_orderkey AS envelope_id", "o_custkey AS transcript_id"), t("customer", "c_custkey AS transcript_id", "c_acctbal < 0 AS auto_generated"))
    return out.select("claim_id", "l_linenumber").distinct()


@query(
    "knw31_wave1_readiness",
    "WITH r AS (SELECT count(CASE WHEN s_acctbal > 0 THEN 1 END) AS core_domains, count(*) AS all_domains, count(CASE WHEN s_acctbal > 5000 THEN 1 END) AS core_ready FROM supplier), s AS (SELECT count(*) AS strategies, count(CASE WHEN o_totalprice > 100000 AND o_orderpriority = '5-LOW' THEN 1 END) AS unprovenanced, count(CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 1 END) AS unretrievable FROM orders WHERE o_orderstatus <> 'F'), "
    "t AS (SELECT count(*) AS tests_defined FROM benchmark) SELECT *, core_domains > 0 AND core_ready = core_domains AND strategies > 0 AND tests_defined > 0 AND unprovenanced = 0 AND unretrievable = 0 AS foundation_ready FROM r, s, t",
)
def _(t):
    ready = t("supplier", "s_acctbal > 0 AS is_core", "s_acctbal > 5000 AS foundation_ready")
    status = "CASE WHEN o_orderstatus = 'F' THEN 'DEPRECATED' WHEN o_totalprice > 100000 THEN 'SUPPORTED' ELSE 'AI_DISCOVERED_CANDIDATE' END AS knowledge_status"
    s = t("orders", "o_orderkey AS strategy_id", status, "nullif(o_orderpriority, '5-LOW') AS provenance_note")
    return foundation.wave1_readiness(ready, s, t("lineitem", "l_orderkey AS strategy_id"), t("benchmark", "true AS active"))


@query("ops08_handoff_registry", "SELECT l_returnflag AS engine, l_linestatus AS mode, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) FILTER (WHERE l_tax > 0.04) AS required_tags, count(*) AS registered_tags FROM lineitem GROUP BY 1, 2")
def _(t):
    rows = t("lineitem", "l_returnflag AS engine", "l_linestatus AS mode", "l_tax > 0.04 AS required", "cast(l_suppkey AS string) AS tag", "true AS active")
    return foundation.handoff_registry(rows).select("engine", "mode", F.array_join("required_tags", ",").alias("required_tags"), "registered_tags")


@query(
    "ret07_curated_bodies",
    "SELECT o_orderkey AS card_id, CASE WHEN b IS NULL THEN o_orderpriority ELSE o_orderpriority || ' ' || b END AS body FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def _(t):
    return foundation.curated_bodies(t("orders", "o_orderkey AS card_id", "o_orderpriority AS name"), t("lineitem", "l_orderkey AS card_id", "l_linenumber AS source_start", "l_returnflag AS text"))


@query("cur10_unlinked_fields", "SELECT doc_id AS field_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return foundation.unlinked_fields(t("documents", "doc_id AS field_id", "text"), t("labels", "doc_id AS field_id")).select("field_id", "n_chars")


@query("knw29_evidence_for", "SELECT l_orderkey AS claim_id, l_linenumber AS evidence_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def _(t):
    claims = t("orders", "o_orderkey AS claim_id", "o_orderstatus").filter("o_orderstatus = 'O'")
    return foundation.evidence_for(claims, t("lineitem", "l_orderkey AS claim_id", "l_linenumber AS evidence_id", "l_shipdate AS created_at")).select("claim_id", "evidence_id")


@query("knw32_foundation_queue", "SELECT c_custkey AS domain_id, coalesce(s, 'DISCOVER') AS stage, coalesce(n, 0) AS passes FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal > 0")
def _(t):
    d = t("customer", "c_custkey AS domain_id", "c_name AS domain_key", "c_acctbal > 0 AS active", "c_nationkey = 1 AS is_core", "c_acctbal AS priority")
    p = t("orders", "o_custkey AS domain_id", "o_orderstatus", "o_orderdate").groupBy("domain_id")
    p = p.agg(F.max("o_orderstatus").alias("stage"), F.count(F.lit(1)).alias("passes"), F.max("o_orderdate").alias("last_advanced"), F.lit(False).alias("paused"))
    return foundation.foundation_queue(d, p).select("domain_id", "stage", "passes")
