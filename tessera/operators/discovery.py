"""Sightings of items, phrases of claims, concept channels of patterns and curated cards, and queries of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import HITS

# Statuses that a second sighting may change.
REDISCOVERABLE = ("DISCOVERED", "QUEUED", "FAILED")


def identify_items(new: DataFrame, items: DataFrame) -> DataFrame:
    """new (source_id, url, guid, ..) with the item_id that it is: by url first, then by source and external id; else null.

    Urls, and external ids within a source, are unique in items. Sightings without url and guid match nothing.
    """
    by_url = items.filter("url is not null").select("url", F.col("item_id").alias("_u"))
    by_id = items.filter("external_id is not null").select("source_id", F.col("external_id").alias("guid"), F.col("item_id").alias("_e"))
    rows = new.join(by_url, "url", "left").join(by_id, ["source_id", "guid"], "left")
    return rows.withColumn("item_id", F.coalesce("_u", "_e")).drop("_u", "_e")


def touch_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """items after the last sighting of each (seen: identify_items() with seen_at, title, status, note).

    Empty titles, urls and external ids are filled; status and note change for items that may be found again.
    """
    cols = ["seen_at", "title", "url", "guid", "status", "note"]
    last = seen.filter("item_id is not null").groupBy("item_id").agg(F.max_by(F.struct(*cols), F.struct(*cols)).alias("s"))
    rows = items.join(last, "item_id", "left")
    hit, again = F.col("s").isNotNull(), F.col("ingestion_status").isin(*REDISCOVERABLE)
    changed = {
        "last_seen": F.coalesce("s.seen_at", "last_seen"),
        "title": F.coalesce(F.nullif("title", F.lit("")), "s.title"),
        "url": F.coalesce("url", "s.url"),
        "external_id": F.coalesce("external_id", "s.guid"),
        "access_note": F.when(hit & again, F.col("s.note")).otherwise(F.coalesce("s.note", "access_note")),
        "ingestion_status": F.when(hit & again, F.col("s.status")).otherwise(F.col("ingestion_status")),
    }
    return rows.withColumns(changed).drop("s")


def claim_phrases(cards: DataFrame, fields: list[str], key: str = "envelope_id") -> DataFrame:
    """(key, phrase, field): the distinct phrases of the cards; field is null where a phrase stands in several fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.btrim(f).alias("phrase")) for f in fields])
    rows = cards.select(key, F.explode(pairs).alias("p")).filter("p.phrase <> ''")
    return rows.groupBy(key, F.col("p.phrase").alias("phrase")).agg(F.when(F.count_distinct("p.field") == 1, F.min("p.field")).alias("field"))


def claim_census(phrases: DataFrame, resolved: DataFrame, key: str = "envelope_id") -> DataFrame:
    """(key, seen, known, new); resolved: (key, phrase) of the phrases that have a concept."""
    rows = phrases.join(resolved.select(key, "phrase").distinct().withColumn("_k", F.lit(True)), [key, "phrase"], "left")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.count("_k").alias("known"), F.count_if(F.col("_k").isNull()).alias("new"))


def by_concept_patterns(queries: DataFrame, patterns: DataFrame, links: DataFrame, strategies: DataFrame) -> DataFrame:
    """Hits of patterns (pattern_id, strategy_id, intervention, practical_method) through their strategy's concepts."""
    ok = strategies.filter("knowledge_status <> 'DEPRECATED'").select("strategy_id")
    through = links.join(queries, "concept_id").join(ok, "strategy_id", "left_semi").join(patterns, "strategy_id")
    label = F.coalesce("intervention", "practical_method", F.lit("pattern"))
    hits = through.groupBy("query_id", F.col("pattern_id").alias("id"), label.alias("label"), F.col("concept_id").alias("bucket")).agg(F.max("weight").cast("double").alias("raw"))
    return hits.withColumns({"kind": F.lit("pattern"), "channel": F.lit("concept")}).select(*HITS, "label")


def by_concept_curated(queries: DataFrame, links: DataFrame, cards: DataFrame) -> DataFrame:
    """Hits of curated cards (curated_id, name) by their links (curated_id, concept_id, weight)."""
    rows = links.join(queries, "concept_id").groupBy("query_id", "curated_id", "concept_id").agg(F.max("weight").cast("double").alias("raw")).join(cards, "curated_id")
    out = rows.select("query_id", F.lit("curated_strategy").alias("kind"), F.col("curated_id").alias("id"), F.col("concept_id").alias("bucket"), F.lit("concept").alias("channel"), "raw", F.col("name").alias("label"))
    return out.select(*HITS, "label")


def case_queries(controls: DataFrame, resolutions: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, query_text, concept_ids): phrases then questions joined by blanks, null if empty; the phrases' concepts."""
    none = F.expr("cast(array() AS array<string>)")
    text = F.nullif(F.btrim(F.array_join(F.concat(F.coalesce("phrases", none), F.coalesce("questions", none)), " ")), F.lit(""))
    found = controls.select(key, F.explode("phrases").alias("phrase")).join(resolutions, "phrase")
    found = found.select(key, F.explode("concept_ids").alias("c")).groupBy(key).agg(F.array_sort(F.collect_set("c")).alias("concept_ids"))
    empty = F.expr(f"cast(array() AS {found.schema['concept_ids'].dataType.simpleString()})")
    return controls.select(key, text.alias("query_text")).join(found, key, "left").withColumn("concept_ids", F.coalesce("concept_ids", empty))
