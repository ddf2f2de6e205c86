"""Hybrid retrieval: concept, text and vector channels, merged and reranked for breadth; and its evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.stem import STOP_WORDS as ENGLISH
from tessera.functions.stem import stems
from tessera.operators.resolve import live, top_k

# Channel weights and the pass mark of an evaluation.
WEIGHTS = {"concept": 0.40, "fts": 0.30, "vector": 0.30}
PASS = 0.30
HITS = ["query_id", "kind", "id", "bucket", "channel", "raw"]
#: Words that are broadcast at most; rows of a query and bucket are ranked in so many blocks first.
SENT_WORDS, BLOCKS = 1_000_000, 64
# Words that aren't searched for.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with".split()


def lexemes(c, stop_words: list[str] = STOP_WORDS):
    """Column: lower-case words of letters and digits without stop words."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(*stop_words))


def query_stems(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stem): the distinct English stems of each query, without stop words; a query without any has no rows."""
    words = queries.select(id_col, F.explode(F.array_distinct(lexemes(F.col(text_col), ENGLISH))).alias("lexeme"))
    return words.join(stems(words), "lexeme").select(id_col, "stem").distinct()


def stem_postings(docs: DataFrame, kind: str, id_col: str, text_col: str, bucket_col: str, searched: DataFrame | None = None) -> DataFrame:
    """The inverted index by English stems: (stem, kind, id, bucket, tf). searched (stem): only of these, of a stated set of queries.

    Each distinct word is stemmed once. With searched, texts are dealt by their id once and the words that have its
    stems are sent to them, so that what is counted by id, here and by by_stems(), is counted where it is; the whole
    index is made of words that are counted by document before they meet their stems.
    """
    named = docs.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"), F.col(bucket_col).cast("string").alias("bucket"), F.col(text_col).alias("text"))
    lexeme = F.explode(lexemes(F.col("text"), ENGLISH)).alias("lexeme")
    known = stems(named.select(lexeme))
    if searched is None:
        counted = named.select("kind", "id", "bucket", lexeme).groupBy("lexeme", "kind", "id", "bucket").agg(F.count(F.lit(1)).alias("tf"))
        return counted.join(known, "lexeme").groupBy("stem", "kind", "id", "bucket").agg(F.sum("tf").alias("tf"))
    wanted = searched.select("stem").distinct()
    known = known.join(wanted, "stem", "left_semi")
    known = F.broadcast(known) if wanted.count() <= SENT_WORDS else known
    words = named.filter("text is not null").repartition("id").select("kind", "id", "bucket", lexeme)
    return words.join(known, "lexeme").groupBy("stem", "kind", "id", "bucket").agg(F.count(F.lit(1)).alias("tf"))


def by_stems(queries: DataFrame, index: DataFrame) -> DataFrame:
    """queries (query_id, stem), index of stem_postings(): OR of the stems; the rank is the number of matching occurrences."""
    sent = F.broadcast(queries) if queries.count() <= SENT_WORDS else queries
    hits = index.join(sent, "stem").groupBy("query_id", "kind", "id", "bucket").agg(F.sum("tf").cast("double").alias("raw"))
    return hits.withColumn("channel", F.lit("fts")).select(*HITS)


def with_labels(hits: DataFrame, texts: DataFrame, most: int = 120) -> DataFrame:
    """hits with label: of texts (kind, id, label) the first letters of the hit's own, null if it has none."""
    return hits.join(texts.select("kind", F.col("id").cast("string").alias("id"), F.left("label", F.lit(most)).alias("label")), ["kind", "id"], "left")


def postings(docs: DataFrame, kind: str, id_col: str, text_col: str, bucket_col: str, searched: DataFrame | None = None) -> DataFrame:
    """The inverted index: (lexeme, kind, id, bucket, tf). searched (lexeme): only of these words, of a stated set of queries."""
    rows = docs.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"), F.col(bucket_col).cast("string").alias("bucket"), F.explode(lexemes(F.col(text_col))).alias("lexeme"))
    if searched is not None:
        words = searched.distinct()
        rows = rows.join(F.broadcast(words) if words.count() <= SENT_WORDS else words, "lexeme", "left_semi")
    return rows.groupBy("lexeme", "kind", "id", "bucket").agg(F.count(F.lit(1)).alias("tf"))


def heaviest_concepts(links: DataFrame) -> DataFrame:
    """(id, bucket): of each item's linked concepts (id, concept_id, weight) the heaviest, of equal ones the first."""
    top = links.groupBy("id").agg(F.max("weight").alias("_w"))
    best = links.join(top, "id").filter(F.col("weight") == F.col("_w"))
    return best.groupBy("id").agg(F.min("concept_id").cast("string").alias("bucket"))


def library_postings(parts: dict[str, DataFrame], searched: DataFrame | None = None) -> DataFrame:
    """The inverted index of several corpora: kind -> (id, text, bucket)."""
    return reduce(DataFrame.unionByName, [postings(df, kind, "id", "text", "bucket", searched) for kind, df in parts.items()])


def resolve_keys(keys: DataFrame, concepts: DataFrame) -> DataFrame:
    return keys.join(live(concepts).select("canonical_key", "concept_id"), "canonical_key")


def by_concept(queries: DataFrame, links: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """queries (query_id, concept_id), links (id, concept_id, weight): the heaviest link of each item and concept."""
    ok = items.filter("knowledge_status <> 'DEPRECATED'").select("id")
    hits = queries.join(links, "concept_id").join(ok, "id", "left_semi").groupBy("query_id", "id", "concept_id").agg(F.max("weight").cast("double").alias("raw"))
    return hits.select("query_id", F.lit(kind).alias("kind"), "id", F.col("concept_id").alias("bucket"), F.lit("concept").alias("channel"), "raw")


def by_fts(queries: DataFrame, index: DataFrame) -> DataFrame:
    """queries (query_id, text): OR of the distinct lexemes; the rank is the number of matching occurrences."""
    words = queries.select("query_id", F.explode(F.array_distinct(lexemes(F.col("text")))).alias("lexeme"))
    hits = index.join(words, "lexeme").groupBy("query_id", "kind", "id", "bucket").agg(F.sum("tf").cast("double").alias("raw"))
    return hits.withColumn("channel", F.lit("fts")).select(*HITS)


def by_vector(queries: DataFrame, vectors: DataFrame, kind: str, bucket_col: str, k: int = 100) -> DataFrame:
    """queries (query_id, embedding), vectors (id, embedding, bucket): the k nearest of each query."""
    top = top_k(queries, vectors, "query_id", "id", k).join(vectors.select("id", F.col(bucket_col).cast("string").alias("bucket")), "id")
    return top.select("query_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "bucket", F.lit("vector").alias("channel"), F.col("score").alias("raw"))


def exclude_held_out(chunks: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    held = items.filter("held_out").select("item_id").join(documents, "item_id").select("document_id")
    return chunks.join(held, "document_id", "left_anti")


def normalise_scores(hits: DataFrame) -> DataFrame:
    """hits with score, the share of the best of their query and channel."""
    best = hits.groupBy("query_id", "channel").agg(F.max("raw").alias("_top"))
    return hits.join(best, ["query_id", "channel"]).withColumn("score", F.when(F.col("_top") > 0, F.col("raw") / F.col("_top")).otherwise(0.0)).drop("_top")


def channel_weights(hits: DataFrame) -> DataFrame:
    """(query_id, channel, weight), renormalised over the channels that found something for the query."""
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    rows = hits.groupBy("query_id").agg(F.collect_set("channel").alias("channels"))
    total = F.aggregate("channels", F.lit(0.0), lambda a, c: a + table[c])
    return rows.select("query_id", F.explode("channels").alias("channel"), total.alias("_total")).select("query_id", "channel", (table[F.col("channel")] / F.col("_total")).alias("weight"))


def merge_hits(hits: DataFrame, weights: DataFrame) -> DataFrame:
    best = hits.groupBy("query_id", "kind", "id", "channel").agg(F.max("score").alias("score"), F.collect_set("bucket").alias("b"))
    return _merged(best.join(weights, ["query_id", "channel"]))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "kind", "id").agg(
        F.round(F.sum(F.col("score") * F.col("weight")), 6).alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("b")))).alias("buckets"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.round("score", 6))))).alias("channels"),
    )


def derive_cap(limit, n_concepts):
    return F.greatest(F.lit(1), F.floor(limit / F.greatest(F.lit(1), n_concepts)).cast("int"))


def rerank(rows: DataFrame, limit: int, cap) -> DataFrame:
    """Breadth first: a row is deferred if it is past the cap in all its buckets; deferred rows fill the rest.

    A row with limit better ones in a bucket can't be on the page by it, so each block of a bucket's rows keeps its
    limit best before the bucket is ranked.
    """
    order = [F.desc("score"), "kind", "id"]
    flat = rows.withColumn("bucket", F.explode(F.when(F.size("buckets") > 0, F.col("buckets")).otherwise(F.array(F.lit("_none")))))
    flat = flat.withColumn("_block", F.pmod(F.xxhash64("kind", "id"), F.lit(BLOCKS)))
    for keys in (["query_id", "bucket", "_block"], ["query_id", "bucket"]):
        flat = flat.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= limit)
    kept = [c for c in rows.columns if c not in ("query_id", "kind", "id")]
    out = flat.groupBy("query_id", "kind", "id").agg(F.min("_place").alias("_place"), *(F.first(c).alias(c) for c in kept)).withColumn("deferred", F.col("_place") > cap)
    w = W.partitionBy("query_id").orderBy("deferred", *order)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("_place")


def retrieve(hits: DataFrame, limit: int = 20, n_concepts: int = 1, kinds: list[str] | None = None) -> DataFrame:
    """The page of each query from the hits of all channels: the rows of merge_hits() over normalise_scores(), reranked.

    Hits are put together by item and channel first; the best of each channel, the channels' weights and the scores
    are all taken from these rows, so that the channels run once and their exchange is used again.
    """
    hits = hits.filter(F.col("kind").isin(*kinds)) if kinds else hits
    best = hits.groupBy("query_id", "kind", "id", "channel").agg(F.max("raw").alias("raw"), F.collect_set("bucket").alias("b"))
    # taken with the buckets' number, so that both sides of the join read the same columns
    tops = best.groupBy("query_id", "channel").agg(F.max(F.struct("raw", F.size("b").alias("n")))["raw"].alias("_top"))
    rows = best.join(tops.join(channel_weights(tops), ["query_id", "channel"]), ["query_id", "channel"])
    rows = rows.withColumn("score", F.when(F.col("_top") > 0, F.col("raw") / F.col("_top")).otherwise(0.0))
    return rerank(_merged(rows), limit, derive_cap(F.lit(limit), F.lit(n_concepts)))


def diagnostics(hits: DataFrame, page: DataFrame) -> DataFrame:
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("channel").alias("channels"))
    shown = page.groupBy("query_id").agg(F.count(F.lit(1)).alias("shown"), F.size(F.array_distinct(F.flatten(F.collect_list("buckets")))).alias("buckets_shown"))
    return found.join(shown, "query_id", "left")


def observed_page(hits: DataFrame, folder: str, limit: int = 20, n_concepts: int = 1, kinds: list[str] | None = None) -> tuple[DataFrame, dict]:
    """The page of retrieve(), and metrics of the run that made it: hits, hits of each channel, cap, shown, deferred.

    The hits are written to folder once and the page beside them; what is counted is counted while they are written,
    so the channels run once and no metric reads them again.
    """
    spark, seen, shown = hits.sparkSession, Observation(), Observation()
    hits = hits.filter(F.col("kind").isin(*kinds)) if kinds else hits
    counts = [F.count_if(F.col("channel") == c).alias(f"{c}_hits") for c in WEIGHTS]
    hits.observe(seen, F.count(F.lit(1)).alias("hits"), *counts).write.parquet(f"{folder}/hits")
    page = retrieve(spark.read.schema(hits.schema).parquet(f"{folder}/hits"), limit, n_concepts)
    page.observe(shown, F.count(F.lit(1)).alias("shown"), F.count_if("deferred").alias("deferred")).write.parquet(f"{folder}/page")
    return spark.read.schema(page.schema).parquet(f"{folder}/page"), seen.get | {"cap": max(1, limit // max(1, n_concepts))} | shown.get


def record_hits(page: DataFrame) -> DataFrame:
    return page.select("query_id", F.explode("buckets").alias("concept_id")).distinct().groupBy("concept_id").agg(F.count(F.lit(1)).alias("retrieval_hits"))


def concept_recall(pages: DataFrame, tests: DataFrame) -> DataFrame:
    """tests (query_id, expected array): share of expected buckets that the page reaches."""
    got = pages.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("buckets"))).alias("got"))
    share = F.size(F.array_intersect("expected", F.coalesce("got", F.array().cast("array<string>")))) / F.size("expected")
    return tests.join(got, "query_id", "left").select("query_id", F.round(F.when(F.size("expected") > 0, share), 4).alias("recall"))


def domain_breadth(pages: DataFrame, domains: DataFrame) -> DataFrame:
    """domains (bucket, domain): distinct domains of a page against those that the library spans."""
    total = domains.agg(F.count_distinct("domain").alias("ceiling"))
    got = pages.select("query_id", F.explode("buckets").alias("bucket")).join(domains, "bucket").groupBy("query_id").agg(F.count_distinct("domain").alias("n"))
    out = pages.select("query_id").distinct().join(got, "query_id", "left").crossJoin(F.broadcast(total))
    return out.select("query_id", F.round(F.try_divide(F.coalesce("n", F.lit(0)), F.col("ceiling")), 4).alias("breadth"))


def run_layer(scores: DataFrame, score: str = "recall") -> DataFrame:
    """One row: tests, scorable ones, passes, mean of the scorable."""
    return scores.agg(
        F.count(F.lit(1)).alias("tests_run"), F.count(score).alias("scorable"), F.count_if(F.col(score) >= PASS).alias("passed"), F.round(F.avg(score), 4).alias("mean_score")
    )


def discovery_value(items: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates by verdict; pooled over all items of a key."""
    n = F.count_if(F.col("verdict").isNotNull())
    useful = F.count_if(F.col("verdict") == "USEFUL")
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("presented"), n.alias("decided"), useful.alias("useful"), F.round(F.try_divide(useful, n), 4).alias("useful_rate"))
