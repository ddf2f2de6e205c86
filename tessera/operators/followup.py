"""Follow-up of cases: assessments, missing data, plan items, responses and candidate facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.cases import LIVE, latest

# Tiers of plan items, outcomes, and statuses that an outcome may set.
TIERS = ("PRIMARY", "SUPPORTIVE", "OPTIONAL")
OUTCOMES = ("IMPROVING", "STABLE", "WORSENING", "LIMITED_RESPONSE", "TOO_EARLY", "NOT_TRACKED")
STATUSES = ("ONGOING", "MODIFIED", "PAUSED", "STOPPED", "COMPLETED")
NAME_CHARS = 200


def _word(c):
    return F.upper(F.btrim(F.coalesce(c, F.lit(""))))


def intake_completeness(submissions: DataFrame, sections: DataFrame, reports: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each submission with its sections present, not applicable and defined, and its open and high gaps."""
    sec = sections.groupBy("submission_id").agg(
        F.count_distinct("section").alias("sections_present"), F.count_distinct(F.when(F.col("not_applicable"), F.col("section"))).alias("sections_not_applicable")
    )
    gaps = reports.filter("not resolved").groupBy("submission_id")
    gaps = gaps.agg(F.count(F.lit(1)).alias("open_gaps"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("high_priority_gaps"))
    defined = catalog.filter("active and not rht_owned").agg(F.count_distinct("section").alias("sections_defined"))
    out = submissions.join(sec, "submission_id", "left").join(gaps, "submission_id", "left").join(F.broadcast(defined))
    return out.fillna(0, ["sections_present", "sections_not_applicable", "open_gaps", "high_priority_gaps"])


def missing_recurrence(reports: DataFrame) -> DataFrame:
    """Reports of each missing field; the highest severity is the last one by text."""
    return reports.groupBy("missing_field").agg(
        F.count(F.lit(1)).alias("reports"),
        F.count_distinct("client_id").alias("distinct_clients"),
        F.count_if("constrained_reasoning").alias("constrained_reasoning_count"),
        F.array_sort(F.collect_set("engine")).alias("engines"),
        F.count("engine").alias("engine_reports"),
        F.count("submission_id").alias("intake_reports"),
        F.max("severity").alias("max_severity"),
        F.min("classification").alias("classification"),
    )


def assessment_package(assessments: DataFrame, layers: DataFrame) -> DataFrame:
    """One row per assessment: its layers as a map from type to payload (of equal types the last), and their number."""
    one = layers.groupBy("assessment_id", "layer_type").agg(F.max_by("payload", "layer_id").alias("payload"), F.count(F.lit(1)).alias("n"))
    packed = one.groupBy("assessment_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer_type", "payload")))).alias("layers"), F.sum("n").alias("layer_count"))
    out = assessments.join(packed, "assessment_id", "left").fillna(0, ["layer_count"])
    return out.withColumn("observation_cardinality", F.lit("SINGLE_ASSESSMENT"))


def assessment_status(clients: DataFrame, assessments: DataFrame, instrument: str) -> DataFrame:
    """Status of each client's last assessment that is not superseded; undated ones come last; else NOT_ASSESSED."""
    mine = assessments.filter((F.col("instrument") == instrument) & (F.col("status") != "SUPERSEDED"))
    last = latest(mine, ["client_id"], ["assessed_on", "assessment_id"], ["status"])
    return clients.select("client_id").join(last, "client_id", "left").fillna("NOT_ASSESSED", ["status"])


def land_plan_items(blocks: DataFrame, json_col: str = "items") -> tuple[DataFrame, DataFrame]:
    """(landed, refused): items of JSON arrays as proposed interventions; nameless items are refused and counted."""
    kind = "array<struct<name:string,tier:string,purpose:string>>"
    rows = blocks.withColumn("_i", F.explode(F.from_json(json_col, kind))).withColumn("name", F.left(F.btrim("_i.name"), F.lit(NAME_CHARS)))
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    tier = _word(F.col("_i.tier"))
    landed = rows.filter(named).select(
        "client_id", "name", F.when(tier.isin(*TIERS), tier).otherwise("SUPPORTIVE").alias("tier"),
        F.nullif(F.btrim("_i.purpose"), F.lit("")).alias("purpose"), F.lit("PROPOSED").alias("status"),
    )
    return landed, rows.filter(~named).groupBy("client_id").agg(F.count(F.lit(1)).alias("refused"))


def followup_queue(followups: DataFrame, clients: DataFrame, interventions: DataFrame, cycles: DataFrame) -> DataFrame:
    """Follow-ups that wait, oldest first, with live interventions and the last cycle's hops and budget."""
    live = interventions.filter(F.col("status").isin(*LIVE)).groupBy("client_id").agg(F.count(F.lit(1)).alias("live_interventions"))
    last = latest(cycles, ["client_id"], ["opened_at", "cycle_id"], ["loop_count", "max_loops"])
    rows = followups.filter("processed_at is null").join(clients, "client_id").join(live, "client_id", "left")
    rows = rows.join(last.withColumnsRenamed({"loop_count": "last_cycle_hops", "max_loops": "last_cycle_budget"}), "client_id", "left")
    return rows.fillna(0, ["live_interventions"]).orderBy("submitted_on", "followup_id")


def intervention_response(interventions: DataFrame, history: DataFrame) -> DataFrame:
    """Each intervention with how often and when last it was assessed; never assessed is not the same as no effect."""
    seen = history.groupBy("intervention_id").agg(F.count(F.lit(1)).alias("times_assessed"), F.max("recorded_at").alias("last_assessed_at"))
    out = interventions.join(seen, "intervention_id", "left").fillna(0, ["times_assessed"])
    return out.withColumn("never_assessed", F.col("times_assessed") == 0)


def live_interventions(interventions: DataFrame, history: DataFrame) -> DataFrame:
    return intervention_response(interventions.filter(F.col("status").isin(*LIVE)), history)


def land_outcomes(blocks: DataFrame, interventions: DataFrame, json_col: str = "outcomes") -> tuple[DataFrame, DataFrame]:
    """(written, unmatched): outcomes matched to a client's live interventions by trimmed lower name.

    An unknown outcome is NOT_TRACKED, an unknown status leaves the status; of equal names the largest id is taken.
    """
    kind = "array<struct<name:string,outcome:string,status:string>>"
    rows = blocks.withColumn("_i", F.explode(F.from_json(json_col, kind))).withColumn("_n", F.lower(F.btrim(F.coalesce("_i.name", F.lit("")))))
    live = interventions.filter(F.col("status").isin(*LIVE)).withColumn("_n", F.lower(F.btrim("name")))
    live = live.groupBy("client_id", "_n").agg(F.max_by(F.struct("intervention_id", "status"), "intervention_id").alias("_t"))
    rows = rows.join(live, ["client_id", "_n"], "left")
    value, status = _word(F.col("_i.outcome")), _word(F.col("_i.status"))
    written = rows.filter("_t is not null").select(
        "client_id", F.col("_t.intervention_id").alias("intervention_id"), F.when(value.isin(*OUTCOMES), value).otherwise("NOT_TRACKED").alias("outcome"),
        F.when(status.isin(*STATUSES), status).otherwise(F.col("_t.status")).alias("status"),
    )
    return written, rows.filter("_t is null").groupBy("client_id").agg(F.count(F.lit(1)).alias("unmatched"))


def audit_facts(facts: DataFrame) -> DataFrame:
    """Approved facts without an authorization and a named approver, and facts with a confidence outside 0 to 1."""
    allowed = F.col("authorization_type").isNotNull() & (F.coalesce(F.btrim("approved_by"), F.lit("")) != "")
    why = F.when((F.col("status") == "APPROVED") & ~allowed, "APPROVED_WITHOUT_AUTHORITY").when(~F.col("extraction_confidence").between(0, 1), "CONFIDENCE_RANGE")
    return facts.withColumn("violation", why).filter("violation is not null")
