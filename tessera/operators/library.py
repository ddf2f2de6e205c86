"""Library governance: claims, queues, merges, readiness, quality; failures in a row; curated headings; embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import norm_phrase
from tessera.operators.packed import most_shared

# Kinds of claims, dimensions and bars of readiness, failures in a row that pause a key.
CLAIM_TYPES = ("SAFETY", "INTERVENTION_EFFECT", "MECHANISM", "DIAGNOSTIC", "OTHER")
DIMENSIONS, DEPTH, PAUSE_AFTER = 18, 14, 3
CARD = "array<struct<text:string,claim_type:string,confidence:double,intervention:string,target:string>>"


def land_claims(raw: DataFrame, json_col: str = "cards", id_col: str = "envelope_id") -> DataFrame:
    rows = raw.select(id_col, F.posexplode(F.from_json(json_col, CARD)).alias("pos", "c")).filter(F.btrim(F.col("c.text")) != "")
    ok = F.col("c.confidence").between(0, 1)
    kind = F.when(F.col("c.claim_type").isin(*CLAIM_TYPES), F.col("c.claim_type")).otherwise("OTHER")
    return rows.select(id_col, "pos", F.btrim(F.col("c.text")).alias("text"), kind.alias("claim_type"), F.when(ok, F.col("c.confidence")).alias("confidence"), "c.intervention", "c.target")


def classify_delta(census: DataFrame) -> DataFrame:
    """census: claims, new."""
    return census.withColumn("delta_class", F.when(F.col("claims") == 0, "LOW_INFORMATION_GAIN").when(F.col("new") == 0, "SUPPORTS_EXISTING").otherwise("NEW_CLAIM_REQUIRES_RESEARCH"))


def research_queue(claims: DataFrame) -> DataFrame:
    rank = F.when(F.col("claim_type") == "SAFETY", 0).otherwise(1)
    return claims.filter("claim_type in ('SAFETY', 'INTERVENTION_EFFECT') and finding is null").orderBy(rank, "claim_id")


def synthesis_queue(claims: DataFrame, links: DataFrame) -> DataFrame:
    return claims.filter("finding is not null").join(links, "claim_id", "left_anti")


def merge_links(merges: DataFrame, links: DataFrame, column: str) -> DataFrame:
    """Links of merged strategies go to the winner unless it has the same one; merges: loser, winner."""
    m = merges
    moved = links.join(m, links.strategy_id == m.loser).select(F.col("winner").alias("strategy_id"), column, *[c for c in links.columns if c not in ("strategy_id", column)])
    rest = links.join(m, links.strategy_id == m.loser, "left_anti")
    return rest.unionByName(moved.dropDuplicates(["strategy_id", column]).join(rest.select("strategy_id", column), ["strategy_id", column], "left_anti").select(*rest.columns))


def land_gaps(records: DataFrame, gaps: DataFrame) -> DataFrame:
    """New gaps: not blank, not open already in their domain under the same normalised question."""
    have = gaps.filter("status in ('OPEN', 'RESEARCHING')").select("domain", norm_phrase(F.col("question")).alias("_q"))
    severity = F.when(F.col("severity").isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), F.col("severity")).otherwise("MEDIUM")
    rows = records.filter(F.btrim("question") != "").withColumn("_q", norm_phrase(F.col("question"))).withColumn("severity", severity)
    return rows.dropDuplicates(["domain", "_q"]).join(have, ["domain", "_q"], "left_anti").drop("_q")


def gap_queue(gaps: DataFrame, strategies: DataFrame) -> DataFrame:
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}.items() for x in kv]), F.col("severity"))
    n = strategies.groupBy("domain").agg(F.count(F.lit(1)).alias("strategies"))
    return gaps.filter("status = 'OPEN'").join(n, "domain", "left").fillna(0, ["strategies"]).orderBy(rank, F.desc("importance"), "raised_at", "gap_id")


def readiness(rows: DataFrame, group: str, member: str, item: str, need: int, depth: int) -> DataFrame:
    """Per group: members covered by at least need distinct items, the missing ones, and whether depth are covered."""
    n = rows.groupBy(group, member).agg(F.count_distinct(item).alias("n"))
    ok = F.col("n") >= need
    return n.groupBy(group).agg(F.count_if(ok).alias("covered"), F.array_join(F.array_sort(F.collect_list(F.when(~ok, F.col(member).cast("string")))), ",").alias("missing")).withColumn("deep", F.col("covered") >= depth)


def floors(metrics: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(metric, n, floor, met): a count of each table against its floor."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("metric"), "n", F.lit(f).cast("long").alias("floor")) for k, (df, f) in metrics.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("met", F.col("n") >= F.col("floor"))


def provenance_audit(df: DataFrame, status: str, source: str) -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("total"), F.count(source).alias("with_source"), F.count_if(F.col(source).isNull()).alias("missing"))


def quality_issues(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(issue, key) of each issue's rows."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("issue"), F.col(key).cast("string").alias("key")) for k, (df, key) in parts.items()])


def fold_progress(events: DataFrame, key: str, ok: str, order: list[str]) -> DataFrame:
    """Per key: passes, failures, failures since the last success, and whether that pauses it."""
    after = F.max(F.when(F.col(ok), F.struct(*order))).over(W.partitionBy(key))
    rows = events.withColumn("_last", after)
    since = F.count_if(~F.col(ok) & (F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))))
    out = rows.groupBy(key).agg(F.count_if(F.col(ok)).alias("passes"), F.count_if(~F.col(ok)).alias("failures"), since.alias("failing"))
    return out.withColumn("paused", F.col("failing") >= PAUSE_AFTER)


def candidate_strategies(links: DataFrame, claim_concepts: DataFrame, limit: int = 8) -> DataFrame:
    """(claim_id, strategy_id, shared): of each claim the strategies with the most distinct concepts in common; of equal ones the smallest, null last."""
    return most_shared(claim_concepts, links, "concept_id", "claim_id", "strategy_id", "shared", limit)


def heading_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, level, heading, start, body, end): markdown headings with code-point offsets of the heading, of the text below it and of its end."""
    lines = docs.select(id_col, F.length(text_col).alias("_n"), F.posexplode(F.split(text_col, "\n")).alias("_i", "_line"))
    w = W.partitionBy(id_col).orderBy("_i")
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("_line") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    heads = lines.filter(F.col("_line").rlike(r"^#{1,6}\s+\S")).withColumn("ord", F.row_number().over(w) - 1).withColumn("end", F.coalesce(F.lead("start").over(w), F.col("_n").cast("long")))
    return heads.select(id_col, "ord", F.length(F.regexp_extract("_line", r"^(#{1,6})", 1)).alias("level"), F.btrim(F.regexp_replace("_line", r"^#{1,6}\s+", "")).alias("heading"), "start", F.least(F.col("start") + F.length("_line") + 1, F.col("_n").cast("long")).alias("body"), "end")


def classify_headings(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Each heading with the block_kind of its first matching active rule, else REVIEW_REQUIRED; rules are a bounded registry."""
    r = F.broadcast(rules.filter("active").select("rule_id", F.regexp_replace("pattern", r"\(\?P<", "(?<").alias("pattern"), "block_kind", F.col("heading_level").alias("_l"), "priority"))
    hit = blocks.join(r, F.expr("rlike(heading, concat('(?i)', pattern)) and (_l is null or _l = level)"))
    best = hit.groupBy("doc_id", "ord").agg(F.min_by("block_kind", F.struct("priority", "rule_id")).alias("block_kind"))
    return blocks.join(best, ["doc_id", "ord"], "left").withColumn("block_kind", F.coalesce("block_kind", F.lit("REVIEW_REQUIRED")))


def attach_owners(blocks: DataFrame) -> DataFrame:
    """Each subsection with its nearest previous heading of a lower level; without a STRATEGY or PRINCIPLE there it goes to review.

    The stack of open headings is one running fold: the last heading of each level, in order.
    """
    w = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    opened = [F.max(F.when(F.col("level") == k, F.struct("ord", "block_kind"))).over(w) for k in range(1, 7)]
    out = blocks
    for k, c in enumerate(opened, 1):
        out = out.withColumn(f"_o{k}", c)
    best = F.greatest(*[F.when(F.col("level") > k, F.col(f"_o{k}")) for k in range(1, 7)])
    out = out.withColumn("_own", best).drop(*[f"_o{k}" for k in range(1, 7)])
    good = F.col("_own.block_kind").isin("STRATEGY", "PRINCIPLE")
    sub = F.col("block_kind") == "SUBSECTION"
    return out.withColumn("owner_ord", F.when(sub & good, F.col("_own.ord"))).withColumn("block_kind", F.when(sub & ~F.coalesce(good, F.lit(False)), "REVIEW_REQUIRED").otherwise(F.col("block_kind"))).drop("_own")


def verify_spans(fields: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Fields whose text isn't what stands in the source at their span."""
    joined = fields.join(docs, "doc_id")
    return joined.filter(F.substring(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("value"))


def stale_embeddings(df: DataFrame, text_col: str) -> DataFrame:
    text = F.btrim(F.coalesce(F.col(text_col), F.lit("")))
    return df.filter((text != "") & (F.col("embedding").isNull() | F.col("text_hash").isNull() | (F.sha2(text_col, 256) != F.col("text_hash"))))


def embedding_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("embedded")).withColumn("table_name", F.lit(k)) for k, df in tables.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("never", F.col("n") - F.col("embedded"))


def audit_vectors(df: DataFrame, dims: int) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return df.withColumn("dims_ok", F.size("embedding") == dims).withColumn("norm_ok", F.abs(norm - 1) <= 1e-3)


def embedding_state(df: DataFrame, order: str) -> DataFrame:
    """Per table its pinned model, that of the first row written, and the rows of other models."""
    pin = df.groupBy("table_name").agg(F.min_by("model", order).alias("pinned_model"))
    return df.join(F.broadcast(pin), "table_name").groupBy("table_name", "pinned_model").agg(F.count_if(F.col("model") != F.col("pinned_model")).alias("violations"))
