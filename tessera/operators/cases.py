"""Case data: latest facts, timelines, rule findings, follow-up; and de-identified cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import adherence_band, norm_phrase
from tessera.operators.phrases import PART_BYTES, find_phrases

# Statuses under which an intervention is live, and the least people of a cohort.
LIVE = ("PROPOSED", "APPROVED", "STARTED", "ONGOING", "MODIFIED")
MIN_COHORT = 5
# Fixed value: letters of the shortest name or reference that is looked for.
MIN_NAME = 3
#: Patterns of a registry that names are compared with one by one.
FEW_PATTERNS = 64


def latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The row of each key that is last by order; an aggregation, so a key of many rows is combined in parts."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}") for c in cols])


def timeline(parts: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(client_id, at, kind, detail): kind -> (df, client column, time column, SQL of the detail)."""
    rows = [df.select(F.col(c).alias("client_id"), F.col(t).alias("at"), F.lit(kind).alias("kind"), F.expr(d).alias("detail")) for kind, (df, c, t, d) in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def current_state(versions: DataFrame, holds: DataFrame, interventions: DataFrame, labs: DataFrame) -> DataFrame:
    """The current version of each client with open holds, live interventions and its latest labs."""
    h = holds.filter("status = 'OPEN'").groupBy("client_id").agg(F.count(F.lit(1)).alias("open_holds"))
    i = interventions.filter(F.col("status").isin(*LIVE)).groupBy("client_id").agg(F.array_sort(F.collect_list("name")).alias("active"))
    lab = latest(labs, ["client_id", "marker"], ["measured_on", "lab_id"], ["value", "measured_on"])
    lab = lab.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("marker", "value", "measured_on"))).alias("labs"))
    out = versions.filter("is_current").join(h, "client_id", "left").join(i, "client_id", "left").join(lab, "client_id", "left")
    return out.fillna(0, ["open_holds"])


def append_versions(states: DataFrame, existing: DataFrame) -> DataFrame:
    """SCD2: new states get the next numbers; only a client's last version is current; empty states are refused."""
    new = states.filter("state is not null and state <> ''")
    top = existing.groupBy("client_id").agg(F.max("version").alias("_top"))
    new = new.join(top, "client_id", "left").withColumn("version", F.coalesce("_top", F.lit(0)) + F.row_number().over(W.partitionBy("client_id").orderBy("created_at", "state"))).drop("_top")
    rows = existing.drop("is_current").unionByName(new)
    return rows.withColumn("is_current", F.lead("version").over(W.partitionBy("client_id").orderBy("version")).isNull())


def supersede(submissions: DataFrame) -> DataFrame:
    last = F.row_number().over(W.partitionBy("client_id").orderBy(F.desc("created_at"), F.desc("submission_id")))
    return submissions.withColumn("status", F.when((last > 1) & F.col("status").isin("DRAFT", "SUBMITTED"), "SUPERSEDED").otherwise(F.col("status")))


def fold_outcomes(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Each event with the value before it; rows that repeat the value are left out."""
    w = W.partitionBy(key).orderBy(*order)
    rows = events.withColumn("old_value", F.lag(value).over(w))
    return rows.filter(~F.col("old_value").eqNullSafe(F.col(value)))


def match_class(names: DataFrame, patterns: DataFrame, name: str) -> DataFrame:
    """(.., match_class): names that contain a pattern of a class, both normalised.

    Up to FEW_PATTERNS patterns are compared one by one; of more, an automaton finds those of each distinct name.
    """
    own = "_norm"
    while own in names.columns:
        own += "_"
    p = patterns.filter("active").select("match_class", norm_phrase(F.col("pattern")).alias("_p")).distinct()
    rows, few = names.withColumn(own, norm_phrase(F.col(name))), p
    many = p.limit(FEW_PATTERNS + 1).count() > FEW_PATTERNS
    if many:
        few = p.filter("_p = ''")
    out = rows.join(F.broadcast(few), F.col(own).contains(F.col("_p"))).drop("_p", own)
    if many:
        found = find_phrases(rows.select(own).distinct(), own, own, p, "_p").withColumnRenamed("phrase", "_p")
        found = found.join(p, "_p").select(own, "match_class").distinct()
        out = out.unionByName(rows.join(found, own).drop(own))
    return out.distinct()


def rule_critical(latest_values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Latest values beyond a marker's thresholds, joined on upper(trim(marker)); no unit is converted."""
    t = F.broadcast(thresholds.filter("active").select(F.upper(F.btrim("marker")).alias("_m"), "rule_key", "critical_low", "critical_high"))
    rows = latest_values.join(t, F.upper(F.btrim("marker")) == F.col("_m")).filter("value < critical_low or value > critical_high")
    return rows.select("client_id", "rule_key", F.lit("HOLD").alias("severity"), F.concat_ws(" ", "marker", F.col("value").cast("string")).alias("detail"))


def rule_pair(medications: DataFrame, interventions: DataFrame, patterns: DataFrame, med_class: str, int_class: str, rule_key: str) -> DataFrame:
    """Clients with a current medication of one class and a live intervention of another."""
    meds = match_class(medications.filter("status = 'CURRENT'"), patterns.filter(F.col("match_class") == med_class), "name").select("client_id").distinct()
    ints = match_class(interventions.filter(F.col("status").isin(*LIVE)), patterns.filter(F.col("match_class") == int_class), "name").join(meds, "client_id", "left_semi")
    return ints.groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("detail")).select("client_id", F.lit(rule_key).alias("rule_key"), F.lit("HOLD").alias("severity"), "detail")


def rule_condition(conditions: DataFrame, patterns: DataFrame, match: str, rule_key: str) -> DataFrame:
    hit = match_class(conditions.filter("status = 'ACTIVE'"), patterns.filter(F.col("match_class") == match), "condition")
    return hit.groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_set("condition")), "; ").alias("detail")).select("client_id", F.lit(rule_key).alias("rule_key"), F.lit("HOLD").alias("severity"), "detail")


def rule_worsening(interventions: DataFrame) -> DataFrame:
    rows = interventions.filter("outcome = 'WORSENING' and status in ('STARTED', 'ONGOING', 'MODIFIED')")
    return rows.groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("detail")).select("client_id", F.lit("WORSENING").alias("rule_key"), F.lit("NOTE").alias("severity"), "detail")


def apply_rules(findings: list[DataFrame], flags: DataFrame) -> DataFrame:
    """Findings of all rules without those for which the client has an open flag."""
    rows = reduce(DataFrame.unionByName, findings)
    return rows.join(flags.filter("status = 'OPEN'").select("client_id", "rule_key"), ["client_id", "rule_key"], "left_anti")


def review_queue(reviews: DataFrame, flags: DataFrame) -> DataFrame:
    counts = flags.filter("status = 'OPEN'").groupBy("client_id").agg(F.count_if(F.col("severity") == "HOLD").alias("holds"), F.count_if(F.col("severity") == "NOTE").alias("notes"))
    return reviews.filter("status = 'PENDING'").join(counts, "client_id", "left").fillna(0, ["holds", "notes"]).orderBy(F.desc("holds"), "client_id")


def release_readiness(clients: DataFrame, flags: DataFrame, approvals: DataFrame) -> DataFrame:
    held = flags.filter("status = 'OPEN' and severity = 'HOLD'").groupBy("client_id").agg(F.count(F.lit(1)).alias("open_holds"))
    ok = approvals.filter("decision = 'APPROVED'").select("client_id", F.lit(True).alias("approved")).distinct()
    out = clients.join(held, "client_id", "left").join(ok, "client_id", "left").fillna(0, ["open_holds"]).fillna(False, ["approved"])
    return out.withColumn("ready", (F.col("open_holds") == 0) & F.col("approved"))


def scoped(df: DataFrame, client_id) -> DataFrame:
    """Only one client's rows; without a client no rows."""
    return df.limit(0) if client_id is None else df.filter(F.col("client_id") == F.lit(client_id))


def cohort_candidates(rows: DataFrame) -> DataFrame:
    """rows: strategy, client_id, assessed, started. People are counted once; small cohorts are blocked."""
    out = rows.groupBy("strategy").agg(
        F.count_distinct("client_id").alias("exposed"), F.count_distinct(F.when(F.col("assessed"), F.col("client_id"))).alias("assessed"),
        F.count(F.lit(1)).alias("interventions"), F.min("started").alias("first_start"), F.max("started").alias("last_start"),
    )
    short = F.col("assessed") < MIN_COHORT
    return out.withColumn("meets", ~short).withColumn("blocked", F.when(short, F.format_string("%d of %d needed", F.col("assessed"), F.lit(MIN_COHORT))))


def observations(outcomes: DataFrame) -> DataFrame:
    """One row for a strategy's client: the latest by (recorded, id); of rows equal in both the one of the largest outcome and adherence, in whatever order they are read."""
    return latest(outcomes, ["strategy", "client_id"], ["recorded_at", "intervention_id", "outcome", "adherence"], ["outcome", "adherence"])


def cohort_summary(obs: DataFrame) -> DataFrame:
    """Counts by outcome and adherence band as texts, count downwards, for cohorts of MIN_COHORT people and more."""

    def told(col):
        n = obs.groupBy("strategy", F.col(col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        one = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "k", "n")))
        return n.groupBy("strategy").agg(F.array_join(F.transform(one, lambda x: F.concat(x["k"], F.lit(" "), x["n"].cast("string"))), ", ").alias(f"{col}_counts"), F.sum("n").alias("people"))

    obs = obs.withColumn("band", adherence_band(F.col("adherence")))
    unknown = obs.groupBy("strategy").agg((2 * F.count_if(F.col("band") == "UNKNOWN") > F.count(F.lit(1))).alias("mostly_unknown"))
    out = told("outcome").join(told("band").drop("people"), "strategy").join(unknown, "strategy")
    return out.filter(F.col("people") >= MIN_COHORT)


def client_phrases(clients: DataFrame) -> DataFrame:
    """(kind, phrase): the display names and external references of clients, trimmed and folded to lower case, each once."""
    told = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lower(F.btrim(F.col(c).cast("string"))).alias("phrase")) for kind, c in (("NAME", "display_name"), ("REFERENCE", "external_ref"))]))
    return clients.select(told).filter(F.length("phrase") >= MIN_NAME).distinct()


def scan_clients(rows: DataFrame, key: str, text: str, clients: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, kind, phrase): each client name and reference that a text carries, in any case and within words too.

    clients: (display_name, external_ref). Names are read as they are written, without wildcards. Null texts carry none.
    """
    phrases = client_phrases(clients)
    found = find_phrases(rows.select(key, F.lower(F.col(text)).alias("_text")), key, "_text", phrases, "phrase", part_bytes).distinct()
    return found.join(phrases, "phrase").select(key, "kind", "phrase")


def scan_identifiers(rows: DataFrame, key: str, text: str, clients: DataFrame | None = None) -> DataFrame:
    """(key, has_uuid, has_email, has_phone) for texts that carry one; with clients has_name and has_reference as well."""
    c = F.coalesce(F.col(text), F.lit(""))
    out = rows.select(
        key, c.rlike(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}").alias("has_uuid"),
        c.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("has_email"), c.rlike(r"\+?[0-9]{3}[-. ][0-9]{3,4}[-. ][0-9]{4}").alias("has_phone"),
    )
    if clients is None:
        return out.filter("has_uuid or has_email or has_phone")
    named = scan_clients(rows, key, text, clients).groupBy(key).agg(F.bool_or(F.col("kind") == "NAME").alias("has_name"), F.bool_or(F.col("kind") == "REFERENCE").alias("has_reference"))
    out = out.join(named, key, "left").fillna(False, ["has_name", "has_reference"])
    return out.filter("has_uuid or has_email or has_phone or has_name or has_reference")


def refuse_identified(aggregates: DataFrame, key: str, texts: list[str], clients: DataFrame) -> DataFrame:
    """The aggregates that may leave the client layer: those none of whose texts, taken together, carries an identifier."""
    told = aggregates.select(key, F.concat_ws(" ", *texts).alias("_text"))
    return aggregates.join(scan_identifiers(told, key, "_text", clients).select(key), key, "left_anti")


def diff_aggregates(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    a = old.select(key, F.struct(*cols).alias("_was"))
    b = new.select(key, F.struct(*cols).alias("_now"))
    change = F.when(F.col("_was").isNull(), "CREATED").when(F.col("_now").isNull(), "GONE").when(F.col("_was").eqNullSafe(F.col("_now")), "UNCHANGED").otherwise("UPDATED")
    return a.join(b, key, "full").select(key, change.alias("change"))


def practice_block(aggregates: DataFrame, strategies: DataFrame, limit: int = 20) -> DataFrame:
    out = aggregates.join(strategies.select("strategy").distinct(), "strategy", "left_semi").orderBy(F.desc("people"), "strategy").limit(limit)
    return out.withColumn("basis", F.lit("PRACTICE_OBSERVATION"))
