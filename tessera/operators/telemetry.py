"""Cost, run and job telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The type of costs: sums and rounding are exact.
COST = "decimal(28,12)"


def exact(c, digits: int = 6):
    """Column: a cost rounded half up at digits, in decimals, as a double."""
    return F.round(c, digits).cast("double")


def exact_mean(c: str, digits: int = 4):
    """Column: the mean of an exact sum, rounded half up at digits; it doesn't depend on the order of the rows."""
    total = F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    return F.floor(total / F.count(c) * 10**digits + 0.5) / 10**digits


def cost_by_operation(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("day", "occurred_at").alias("day"), "operation", "model_role").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("tokens"), exact(F.sum(F.col("cost_usd").cast(COST))).alias("cost"),
        exact_mean("duration_ms").alias("avg_ms"), F.count_if(~F.col("success")).alias("failures"),
    )


def price_calls(calls: DataFrame, prices: DataFrame, call_id: str = "call_id") -> DataFrame:
    """calls with price_source and cost: exact model, else its longest prefix, within the call's modality.

    A null modality is priced only if one modality matches; otherwise the call is UNPRICED and its cost null.
    prices is a bounded rate card, one row per (model_name, modality).
    """
    p = prices.select(F.col("model_name").alias("p_model"), F.col("modality").alias("p_modality"), "in_rate", "out_rate")
    match = F.col("model_name").startswith(F.col("p_model")) & (F.col("modality").isNull() | (F.col("modality") == F.col("p_modality")))
    hits = calls.join(F.broadcast(p), match)
    rank = F.struct((F.col("model_name") == F.col("p_model")).alias("exact"), F.length("p_model").alias("n"))
    best = hits.groupBy(call_id).agg(F.max_by(F.struct("in_rate", "out_rate"), rank).alias("rate"), F.max(rank).alias("rank"), F.count_distinct("p_modality").alias("n_modalities"))
    out = calls.join(best, call_id, "left")
    ok = F.col("rate").isNotNull() & (F.col("modality").isNotNull() | (F.col("n_modalities") == 1))
    rate = lambda c: F.col(f"rate.{c}").cast("decimal(12,6)")
    millionths = F.col("input_tokens").cast("decimal(18,0)") * rate("in_rate") + F.col("output_tokens").cast("decimal(18,0)") * rate("out_rate")
    # a rate is per million tokens, so whole millionths of a unit are what is left of the rounded sum
    cost = F.round(millionths, 0).cast("double") / 1e6
    source = F.when(~ok, "UNPRICED").when(F.col("rank.exact"), "EXACT").otherwise("PREFIX")
    return out.withColumn("price_source", source).withColumn("cost_usd", F.when(ok, cost)).drop("rate", "rank", "n_modalities")


def unpriced_spend(priced: DataFrame) -> DataFrame:
    rows = priced.filter("price_source = 'UNPRICED'")
    return rows.groupBy("model_name", "modality").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("tokens"))


def call_measurement(runs: DataFrame, costs: DataFrame) -> DataFrame:
    by_run = costs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("input_tokens").alias("tokens"), exact(F.sum(F.col("cost_usd").cast(COST))).alias("cost"),
        F.bool_or(F.col("cost_usd").isNull()).alias("unpriced"), F.count_if(~F.col("success")).alias("errors"),
    )
    return runs.join(by_run, "run_id", "left")


def run_health(runs: DataFrame) -> DataFrame:
    return runs.groupBy("engine", "pass", "status").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.sum("attempts").alias("attempts"))


def run_clock(runs: DataFrame) -> DataFrame:
    return runs.withColumn("clock", F.when(F.col("client_id").isNull(), "KNOWLEDGE").otherwise("CASE"))


def incoherent_runs(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Runs whose mode is missing or unregistered, or whose client contradicts the registry (bounded)."""
    reg = registry.groupBy("engine", "engine_mode").agg(F.bool_or("needs_client").alias("needs_client"))
    rows = runs.join(F.broadcast(reg), ["engine", "engine_mode"], "left")
    why = F.when(F.col("engine_mode").isNull(), "MODE_MISSING").when(F.col("needs_client").isNull(), "MODE_UNREGISTERED")
    why = why.when(F.col("needs_client") & F.col("client_id").isNull(), "CLIENT_MISSING").when(~F.col("needs_client") & F.col("client_id").isNotNull(), "CLIENT_UNEXPECTED")
    return rows.withColumn("reason", why).filter("reason is not null").drop("needs_client")


def two_pass_audit(runs: DataFrame) -> DataFrame:
    """Cycles whose passes don't share a prompt hash."""
    return runs.groupBy("cycle_id").agg(F.count_distinct("prompt_hash").alias("hashes")).filter("hashes > 1")


def dead_letter_triage(letters: DataFrame) -> DataFrame:
    return letters.groupBy("job", "entity_type").agg(
        F.count(F.lit(1)).alias("failures"), F.count_if(F.col("resolved_at").isNull()).alias("open"), F.count_if(F.col("client_id").isNull()).alias("without_client"),
        F.min("failed_at").alias("first_at"), F.max("failed_at").alias("last_at"),
    )


def spend_by_day(events: DataFrame) -> DataFrame:
    rows = events.filter(~F.coalesce(F.col("client_work"), F.lit(False)))
    return rows.groupBy(F.to_date("occurred_at").alias("day")).agg(F.sum("input_tokens").alias("tokens"), exact(F.sum(F.col("cost_usd").cast(COST))).alias("cost"))


def budget_remaining(spend: DataFrame, cap: float | None) -> DataFrame:
    left = F.lit(None).cast("double") if cap is None else F.round(F.greatest(F.lit(0.0), F.lit(float(cap)) - F.col("cost")), 6)
    return spend.withColumn("remaining", left)


def extract_blocks(outputs: DataFrame, tags: list[str], text_col: str = "text") -> DataFrame:
    """(.., tag, fields): for each tag the KEY: value lines of its block; a line without a key continues the value before."""
    blocks = F.array(*[F.struct(F.lit(t).alias("tag"), F.regexp_extract(text_col, rf"(?s)<{t}>\s*(?:```\w*\n)?(.*?)(?:```\s*)?</{t}>", 1).alias("body")) for t in tags])
    rows = outputs.select("*", F.inline(blocks)).filter("body <> ''")
    kind = "array<struct<k:string,v:string>>"

    def step(a, line):
        key = F.regexp_extract(line, r"^\s*([A-Z][A-Z0-9_ ]*):", 1)
        value = F.btrim(F.regexp_replace(line, r"^\s*[A-Z][A-Z0-9_ ]*:", ""))
        last = F.try_element_at(a, F.lit(-1))
        longer = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["k"].alias("k"), F.btrim(F.concat(last["v"], F.lit(" "), F.btrim(line))).alias("v"))))
        return F.when(key != "", F.concat(a, F.array(F.struct(F.btrim(key).alias("k"), value.alias("v"))))).when((F.size(a) > 0) & (F.btrim(line) != ""), longer).otherwise(a)

    return rows.withColumn("fields", F.aggregate(F.split("body", "\n"), F.array().cast(kind), step)).drop("body")


def integrity_audit(tables: dict[str, tuple[DataFrame, str, dict[str, str]]]) -> DataFrame:
    """(table, rule, key): rows that break a rule. tables: name -> (df, key column, rule -> SQL predicate)."""
    found = None
    for name, (df, key, rules) in tables.items():
        broken = F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(r)) for r, p in rules.items()])
        rows = df.select(F.lit(name).alias("table"), F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"), F.col(key).cast("string").alias("key"))
        found = rows if found is None else found.unionByName(rows)
    return found
