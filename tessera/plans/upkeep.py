"""Queues, states, safety rules, sources and concept channels on the given tables, each query with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import cases, ingest, library, retrieval, sinks, telemetry
from tessera.plans import core, resolver
from tessera.plans.resolver import ONTOLOGY
from tessera.plans.states import collector
from tessera.sources import readers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = collector(QUERIES, ORACLE)


@query("ing12_video_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN lpad(CAST(o_orderkey AS VARCHAR), 11, 'a') END AS video_id, CASE WHEN o_orderkey % 4 < 3 THEN 'https://www.youtube.com/watch?v=' || lpad(CAST(o_orderkey AS VARCHAR), 11, 'a') END AS url FROM orders")
def _(t):
    key = "lpad(cast(o_orderkey AS string), 11, 'a')"
    rows = t("orders", "o_orderkey", f"CASE o_orderkey % 4 WHEN 0 THEN {key} WHEN 1 THEN 'https://youtu.be/' || {key} || '?t=1' WHEN 2 THEN 'https://x.org/watch?a=1&v=' || {key} ELSE 'https://x.org/' || {key} || 'b' END AS said")
    return rows.select("o_orderkey", X.video_id(F.col("said")).alias("video_id"), X.canonical_video_url(F.col("said")).alias("url"))


@query("ing01_html_text", r"SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?i)</(p|div|h[1-6]|li|tr|section|article)>', chr(10) || chr(10), 'gi'), '(?i)<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g')) > 0 AS has_text FROM pages")
def _(t):
    return t("pages", "page_id", "html").select("page_id", (F.length(X.html_to_text(F.col("html"))) > 0).alias("has_text"))


@query("ing07_rights", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'PRIVATE' WHEN o_orderpriority LIKE '2%' THEN 'LICENSED' ELSE 'PUBLIC' END AS rights, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS excerpt_only, NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%') AS noted FROM orders")
def _(t):
    rows = t("orders", "o_orderkey", "CASE left(o_orderpriority, 1) WHEN '1' THEN 'PRIVATE' WHEN '2' THEN 'LICENSED' WHEN '3' THEN 'PUBLIC' WHEN '4' THEN 'ODD' END AS rights")
    return ingest.normalise_rights(rows).select("o_orderkey", "rights", "excerpt_only", F.col("rights_note").isNotNull().alias("noted"))


@query("ing11_fresh_searches", "SELECT event_id FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events h WHERE h.event_type = 'click' AND h.user_id = e.user_id AND h.user_id % 2 = 1 AND h.ts <= e.ts AND h.ts >= e.ts - INTERVAL 6 HOUR)")
def _(t):
    rows = t("events", "event_id", "ts", "event_type", "cast(user_id AS string) AS query", "CASE WHEN user_id % 2 = 1 THEN 'p' ELSE 'q' END AS adapter")
    adapters = t("region", "CASE WHEN r_regionkey = 0 THEN 'p' ELSE 'q' END AS adapter", "CASE WHEN r_regionkey = 0 THEN 6 ELSE 0 END AS repeat_after_hours").distinct()
    now = rows.filter("event_type = 'view'").select("event_id", "query", "adapter", F.col("ts").alias("at"))
    past = rows.filter("event_type = 'click'").select("query", "adapter", F.col("ts").alias("executed_at"))
    return ingest.suppress_recent(now, past, adapters).select("event_id")


@query("ing16_asr_flag", "SELECT conv_id, CASE WHEN count(*) > 2 THEN conv_id % 2 = 0 END AS auto_generated FROM conversations GROUP BY 1")
def _(t):
    rows = t("conversations", "conv_id", "text").groupBy("conv_id").agg(F.collect_list("text").alias("segments"))
    rows = rows.withColumn("segments", F.when(F.size("segments") > 2, F.col("segments")).otherwise(F.expr("cast(array() AS array<string>)"))).withColumn("isAutoGenerated", F.col("conv_id") % 2 == 0)
    return ingest.asr_flag(rows).select("conv_id", "auto_generated")


@query("ing17_ingestion_status", "SELECT o_orderkey, upper(o_orderpriority) AS label, max_by(l_returnflag, l_linenumber * 100000000 + l_suppkey * 10000 + l_partkey % 10000) AS latest_delta FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(t):
    kinds = t("orders", "o_orderpriority AS kind", "upper(o_orderpriority) AS label").distinct()
    deltas = t("lineitem", "l_orderkey AS envelope_id", "l_returnflag AS delta_class", "l_linenumber * 100000000 + l_suppkey * 10000 + l_partkey % 10000 AS analysis_seq")
    return ingest.ingestion_status(t("orders", "o_orderkey AS envelope_id", "o_orderpriority AS kind"), kinds, deltas).select(F.col("envelope_id").alias("o_orderkey"), "label", "latest_delta")


@query("ing18_client_safe", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id = (SELECT min(d.doc_id) FROM documents d WHERE d.text = documents.text)")
def _(t):
    rows = ingest.dedup_by_hash(t("documents", "doc_id", "sha2(text, 256) AS h", "CASE WHEN lang = 'en' THEN 'PUBLIC' ELSE 'PRIVATE' END AS rights"), "doc_id", "h", "doc_id")
    return ingest.client_safe_sources(rows).select("doc_id")


@query("ing20_due_sources", "SELECT s_suppkey AS source FROM supplier WHERE s_acctbal > 0 AND s_nationkey % 2 = 0")
def _(t):
    return ingest.sources_due(t("supplier", "s_suppkey AS source", "s_acctbal > 0 AS active", "s_nationkey % 2 = 0 AS monitored", "CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey END AS last_checked")).select("source")


@query("ing22_creators", "SELECT l_returnflag AS namespace, l_suppkey AS platform_id, max_by(CAST(l_orderkey AS VARCHAR), l_orderkey * 10 + l_linenumber) AS name FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2")
def _(t):
    rows = t("lineitem", "CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS namespace", "l_suppkey AS platform_id", "cast(l_orderkey AS string) AS name", "l_orderkey * 10 + l_linenumber AS seen_at")
    return ingest.upsert_creators(rows)


@query("snk03_append_log", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    rows = t("events", "event_id", "ts")
    return sinks.logged(rows, "ts").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("ret01_live_keys", ONTOLOGY + "SELECT p_partkey, concept_id FROM part JOIN live ON canonical_key = p_type || '_' || upper(replace(part.p_name, ' ', '_'))")
def _(t):
    keys = t("part", "p_partkey", "p_type || '_' || upper(replace(p_name, ' ', '_')) AS canonical_key")
    return retrieval.resolve_keys(keys, resolver.concepts(t)).select("p_partkey", "concept_id")


@query(
    "ret06_library_channels",
    "WITH b AS (SELECT l_partkey AS id, l_suppkey AS c, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2), h AS (SELECT id, min(c) AS bucket FROM b WHERE w = (SELECT max(w) FROM b x WHERE x.id = b.id) GROUP BY 1), "
    "t AS (SELECT 'strategy' AS kind, p_partkey AS id, p_name || ' ' || p_type AS text, CAST(bucket AS VARCHAR) AS bucket FROM part LEFT JOIN h ON h.id = p_partkey UNION ALL SELECT 'chunk', conv_id * 1000 + turn, text, role FROM conversations UNION ALL SELECT 'concept', n_nationkey, n_name, n_name FROM nation UNION ALL SELECT 'curated_strategy', o_orderkey, o_orderpriority || ' ' || o_orderstatus, CAST(o_custkey AS VARCHAR) FROM orders), "
    "q AS (SELECT DISTINCT p_brand AS query_id, unnest(string_split(lower(p_name), ' ')) AS w FROM part WHERE p_partkey % 50 = 0 UNION SELECT 'urgent', 'urgent' UNION SELECT 'urgent', 'que'), "
    f"ix AS (SELECT kind, id, bucket, lexeme, count(*) AS tf FROM (SELECT kind, id, bucket, unnest({core.LEX.format('text')}) AS lexeme FROM t) GROUP BY ALL) SELECT query_id, kind, CAST(id AS VARCHAR) AS id, bucket, CAST(sum(tf) AS DOUBLE) AS raw FROM ix JOIN q ON w = lexeme GROUP BY 1, 2, 3, 4",
)
def _(t):
    heavy = retrieval.heaviest_concepts(t("lineitem", "l_partkey AS id", "l_suppkey AS concept_id", "l_quantity AS weight"))
    corpora = {
        "strategy": t("part", "p_partkey AS id", "p_name || ' ' || p_type AS text").join(heavy, "id", "left"), "chunk": t("conversations", "conv_id * 1000 + turn AS id", "text", "role AS bucket"),
        "concept": t("nation", "n_nationkey AS id", "n_name AS text", "n_name AS bucket"), "curated_strategy": t("orders", "o_orderkey AS id", "o_orderpriority || ' ' || o_orderstatus AS text", "o_custkey AS bucket"),
    }
    asked = t("part", "p_partkey", "p_brand AS query_id", "p_name AS text").filter("p_partkey % 50 = 0").groupBy("query_id").agg(F.array_join(F.collect_set("text"), " ").alias("text"))
    asked = asked.unionByName(t("region", "'urgent' AS query_id", "'urgent que' AS text").distinct())
    words = asked.select(F.explode(retrieval.lexemes(F.col("text"))).alias("lexeme"))
    return retrieval.by_fts(asked, retrieval.library_postings(corpora, words)).drop("channel")


@query(
    "ret02_by_concept",
    "WITH links AS (SELECT l_orderkey AS id, l_suppkey AS concept_id, l_quantity AS w FROM lineitem), q AS (SELECT n_nationkey AS query_id, s_suppkey AS concept_id FROM nation JOIN supplier ON s_nationkey = n_nationkey) SELECT query_id, id, concept_id AS bucket, max(w) AS raw FROM q JOIN links USING (concept_id) WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1, 2, 3",
)
def _(t):
    queries = t("supplier", "s_nationkey AS query_id", "s_suppkey AS concept_id").join(t("nation", "n_nationkey AS query_id"), "query_id", "left_semi")
    items = t("orders", "o_orderkey AS id", "CASE WHEN o_orderstatus = 'P' THEN 'DEPRECATED' ELSE 'APPROVED' END AS knowledge_status")
    return retrieval.by_concept(queries, t("lineitem", "l_orderkey AS id", "l_suppkey AS concept_id", "l_quantity AS weight"), items, "strategy").select("query_id", "id", "bucket", "raw")


@query("ret09_without_held_out", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    chunks = t("lineitem", "l_orderkey AS document_id", "l_linenumber")
    documents = t("orders", "o_orderkey AS document_id", "o_custkey AS item_id")
    items = t("customer", "c_custkey AS item_id", "c_mktsegment = 'BUILDING' AS held_out")
    return retrieval.exclude_held_out(chunks, documents, items).select(F.col("document_id").alias("l_orderkey"), "l_linenumber")


@query(
    "ret15_diagnostics",
    "WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_orderpriority AS bucket, o_orderstatus AS channel FROM orders), p AS (SELECT DISTINCT query_id, bucket, id FROM h WHERE channel = 'O') SELECT query_id, count(*) AS hits, count(DISTINCT channel) AS channels, s.shown, s.buckets_shown FROM h LEFT JOIN (SELECT query_id, count(*) AS shown, CAST(count(DISTINCT bucket) AS INTEGER) AS buckets_shown FROM p GROUP BY 1) s USING (query_id) GROUP BY query_id, s.shown, s.buckets_shown",
)
def _(t):
    hits = t("orders", "o_custkey AS query_id", "o_orderkey AS id", "o_orderpriority AS bucket", "o_orderstatus AS channel")
    page = hits.filter("channel = 'O'").groupBy("query_id", "id").agg(F.collect_set("bucket").alias("buckets"))
    return retrieval.diagnostics(hits, page)


@query("evl06_layer_run", "WITH s AS (SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') * 1.0 / nullif(count(o_orderkey), 0) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT count(*) AS tests_run, count(r) AS scorable, count(*) FILTER (WHERE r >= 0.3) AS passed FROM s")
def _(t):
    n = t("customer", "c_custkey AS o_custkey").join(t("orders", "o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "left").groupBy("o_custkey")
    scores = n.agg(F.try_divide(F.count_if(F.col("o_orderstatus") == "F"), F.count("o_orderkey")).alias("recall"))
    return retrieval.run_layer(scores).drop("mean_score")


@query("emb04_provenance", "WITH e AS (SELECT label AS table_name, vec_id, 'm' || (vec_id % 3) AS model FROM embeddings), p AS (SELECT table_name, min_by(model, vec_id) AS pinned_model FROM e GROUP BY 1) SELECT table_name, pinned_model, count(*) FILTER (WHERE model <> pinned_model) AS violations FROM e JOIN p USING (table_name) GROUP BY 1, 2")
def _(t):
    return library.embedding_state(t("embeddings", "label AS table_name", "vec_id", "'m' || (vec_id % 3) AS model"), "vec_id")


CARDS = "SELECT l_orderkey, l_linenumber, l_returnflag, l_discount, CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'claim ' || l_partkey END AS text FROM lineitem"


@query("knw01_claims", f"SELECT l_orderkey AS envelope_id, text, CASE l_returnflag WHEN 'A' THEN 'SAFETY' WHEN 'N' THEN 'MECHANISM' ELSE 'OTHER' END AS claim_type, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS confidence FROM ({CARDS}) WHERE trim(text) <> ''")
def _(t):
    rows = t("lineitem", "l_orderkey AS envelope_id", "CASE WHEN l_linenumber = 7 THEN ' ' ELSE ' claim ' || l_partkey END AS text", "CASE l_returnflag WHEN 'A' THEN 'SAFETY' WHEN 'N' THEN 'MECHANISM' ELSE 'ODD' END AS claim_type", "CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE 2 + l_discount END AS confidence")
    raw = rows.groupBy("envelope_id").agg(F.to_json(F.collect_list(F.struct("text", "claim_type", "confidence"))).alias("cards"))
    return library.land_claims(raw).select("envelope_id", "text", "claim_type", "confidence")


@query("knw03_deltas", "SELECT o_orderkey, CASE WHEN count(l_linenumber) = 0 THEN 'LOW_INFORMATION_GAIN' WHEN count(*) FILTER (WHERE l_returnflag = 'A') = 0 THEN 'SUPPORTS_EXISTING' ELSE 'NEW_CLAIM_REQUIRES_RESEARCH' END AS delta_class FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    rows = t("orders", "o_orderkey").join(t("lineitem", "l_orderkey AS o_orderkey", "l_returnflag"), "o_orderkey", "left")
    census = rows.groupBy("o_orderkey").agg(F.count("l_returnflag").alias("claims"), F.count_if(F.col("l_returnflag") == "A").alias("new"))
    return library.classify_delta(census).select("o_orderkey", "delta_class")


CLAIMS = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'SAFETY' WHEN '2' THEN 'INTERVENTION_EFFECT' ELSE 'OTHER' END AS claim_type"


@query("knw05_research_queue", f"SELECT claim_id, claim_type FROM (SELECT o_orderkey AS claim_id, {CLAIMS}, o_orderstatus FROM orders) WHERE claim_type <> 'OTHER' AND o_orderstatus <> 'F'")
def _(t):
    return library.research_queue(t("orders", "o_orderkey AS claim_id", CLAIMS, "CASE WHEN o_orderstatus = 'F' THEN 'x' END AS finding")).select("claim_id", "claim_type")


@query("knw08_synthesis_queue", "SELECT o_orderkey AS claim_id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    return library.synthesis_queue(t("orders", "o_orderkey AS claim_id", "CASE WHEN o_orderstatus = 'F' THEN 'x' END AS finding"), t("lineitem", "l_orderkey AS claim_id", "l_returnflag").filter("l_returnflag = 'R'")).select("claim_id")


@query("knw12_merged_links", "WITH m AS (SELECT l_suppkey, l_partkey, min(CASE WHEN l_suppkey % 10 = 3 THEN l_suppkey - 1 ELSE l_suppkey END) AS w FROM lineitem GROUP BY 1, 2) SELECT DISTINCT w AS strategy_id, l_partkey AS concept_id FROM m")
def _(t):
    links = t("lineitem", "l_suppkey AS strategy_id", "l_partkey AS concept_id").distinct()
    return library.merge_links(t("supplier", "s_suppkey AS loser", "s_suppkey - 1 AS winner").filter("loser % 10 = 3"), links, "concept_id")


@query(
    "knw15_landed_gaps",
    "WITH r AS (SELECT DISTINCT l_suppkey AS domain, 'what of ' || l_shipmode AS q FROM (SELECT l_suppkey, l_returnflag || l_linenumber AS l_shipmode FROM lineitem)) SELECT domain, q AS question FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_suppkey = domain AND o.l_linestatus = 'O' AND o.l_quantity > 40 AND 'what of ' || o.l_returnflag || o.l_linenumber = q)",
)
def _(t):
    records = t("lineitem", "l_suppkey AS domain", "'what of ' || l_returnflag || l_linenumber AS question", "'odd' AS severity")
    have = t("lineitem", "l_suppkey AS domain", "'What  of ' || l_returnflag || l_linenumber || '?' AS question", "CASE WHEN l_linestatus = 'O' AND l_quantity > 40 THEN 'OPEN' ELSE 'CLOSED' END AS status")
    return library.land_gaps(records, have).select("domain", "question")


@query(
    "cas11_current_state",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders), l AS (SELECT o_custkey, string_agg(o_orderpriority || '=' || o_orderkey, '|' ORDER BY o_orderpriority) AS labs FROM r WHERE rn = 1 GROUP BY 1), "
    "h AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), i AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR) AS active FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) "
    "SELECT c_custkey AS client_id, coalesce(n, 0) AS open_holds, coalesce(active, '') AS active, coalesce(labs, '') AS labs FROM customer LEFT JOIN h ON h.o_custkey = c_custkey LEFT JOIN i ON i.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey WHERE c_acctbal > 0",
)
def _(t):
    o = t("orders", "o_custkey AS client_id", "o_orderkey", "o_orderstatus", "o_orderpriority AS marker", "o_orderdate AS measured_on")
    versions = t("customer", "c_custkey AS client_id", "c_acctbal > 0 AS is_current")
    holds = o.selectExpr("client_id", "CASE WHEN o_orderstatus = 'P' THEN 'OPEN' END AS status")
    live = o.selectExpr("client_id", "CASE WHEN o_orderstatus = 'O' THEN 'ONGOING' END AS status", "cast(o_orderkey AS string) AS name")
    labs = o.selectExpr("client_id", "marker", "measured_on", "o_orderkey AS lab_id", "o_orderkey AS value")
    out = cases.current_state(versions, holds, live, labs)
    told = F.array_join(F.transform("labs", lambda x: F.concat(x["marker"], F.lit("="), x["value"].cast("string"))), "|")
    return out.select("client_id", "open_holds", F.coalesce(F.array_join("active", "|"), F.lit("")).alias("active"), F.coalesce(told, F.lit("")).alias("labs"))


@query(
    "src04_feed_entries",
    "SELECT p_brand AS feed, p_name AS title, 'http://x/' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN 'http://x/' || p_partkey ELSE 'g' || p_partkey END AS guid, CASE WHEN p_partkey % 2 = 0 THEN 'in full' ELSE p_type END AS summary, CASE WHEN p_partkey % 5 = 0 THEN 'said ' || p_partkey END AS transcript FROM part",
)
def _(t):
    tag = lambda name, value: f"'<{name}>' || {value} || '</{name}>'"
    item = " || ".join([
        "'<item>'", tag("title", "p_name"), tag("link", "'http://x/' || p_partkey"), f"CASE WHEN p_partkey % 3 = 0 THEN '' ELSE {tag('guid', chr(39) + 'g' + chr(39) + ' || p_partkey')} END",
        f"CASE WHEN p_partkey % 2 = 0 THEN {tag('content:encoded', chr(39) + 'in full' + chr(39))} ELSE {tag('description', 'p_type')} END", f"CASE WHEN p_partkey % 5 = 0 THEN {tag('itunes:transcript', chr(39) + 'said ' + chr(39) + ' || p_partkey')} ELSE '' END", "'</item>'",
    ])
    feeds = t("part", "p_brand AS feed", f"{item} AS item").groupBy("feed").agg(F.array_join(F.collect_list("item"), "").alias("items"))
    head = "'<rss xmlns:content=\"c\" xmlns:itunes=\"i\" version=\"2.0\"><channel>'"
    pages = feeds.selectExpr("feed", f"{head} || items || '</channel></rss>' AS body")
    return readers.feed_entries(pages).select("feed", "title", "url", "guid", "summary", "transcript")


@query("src05_search_results", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MALFORMED' ELSE 'OK' END AS outcome, CAST(o_orderkey AS VARCHAR) AS external_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND c_custkey % 10 <> 0")
def _(t):
    ids = t("orders", "o_custkey AS c_custkey", "cast(o_orderkey AS string) AS id").groupBy("c_custkey").agg(F.to_json(F.collect_list("id")).alias("ids"))
    rows = t("customer", "c_custkey").join(ids, "c_custkey", "left").selectExpr("c_custkey", "CASE WHEN c_custkey % 10 = 0 THEN 'oops' ELSE '{\"esearchresult\":{\"idlist\":' || coalesce(ids, '[]') || '}}' END AS payload")
    return readers.search_results(rows)


@query("cas22_review_queue", "SELECT o_orderkey AS review_id, o_custkey AS client_id, coalesce(holds, 0) AS holds, coalesce(notes, 0) AS notes FROM orders LEFT JOIN (SELECT o_custkey AS c, count(*) FILTER (WHERE o_totalprice > 300000) AS holds, count(*) FILTER (WHERE o_totalprice <= 300000) AS notes FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c = o_custkey WHERE o_orderstatus = 'P'")
def _(t):
    flags = t("orders", "o_custkey AS client_id", "CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status", "CASE WHEN o_totalprice > 300000 THEN 'HOLD' ELSE 'NOTE' END AS severity")
    return cases.review_queue(t("orders", "o_orderkey AS review_id", "o_custkey AS client_id", "CASE WHEN o_orderstatus = 'P' THEN 'PENDING' ELSE 'DONE' END AS status"), flags).drop("status")


PATTERNS = "CASE WHEN p_name LIKE 'red%' THEN 'INSULIN' WHEN p_name LIKE 'blue%' THEN 'FASTING' WHEN p_name LIKE 'hot%' THEN 'PREGNANCY' WHEN p_name LIKE 'old%' THEN 'RENAL' END"


def patterns(t):
    return t("part", f"{PATTERNS} AS match_class", "p_name AS pattern", "true AS active").filter("match_class IS NOT NULL").distinct()


def taken(t, name):
    line = t("lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus").join(t("orders", "o_orderkey AS l_orderkey", "o_custkey AS client_id"), "l_orderkey")
    return line.join(t("part", "p_partkey AS l_partkey", "upper(p_name) AS p_name"), "l_partkey").withColumnRenamed("p_name", name)


TAKEN = "WITH x AS (SELECT o_custkey AS client_id, upper(p_name) AS name, p_name, l_returnflag, l_linestatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey) "


CLASSES = f"m AS (SELECT DISTINCT p_name AS pattern, {PATTERNS} AS match_class FROM part WHERE {PATTERNS} IS NOT NULL) "


@query("cas24_match_class", f"WITH {CLASSES} SELECT DISTINCT p_partkey, match_class FROM part JOIN m ON contains(p_name, pattern)")
def _(t):
    return cases.match_class(t("part", "p_partkey", "upper(p_name) AS name"), patterns(t), "name").select("p_partkey", "match_class")


@query("cas26_rule_pair", TAKEN + "SELECT client_id, 'HYPO' AS rule_key, 'HOLD' AS severity, string_agg(DISTINCT name, '; ' ORDER BY name) AS detail FROM x WHERE p_name LIKE 'blue%' AND l_linestatus = 'O' AND client_id IN (SELECT client_id FROM x WHERE p_name LIKE 'red%' AND l_returnflag = 'A') GROUP BY 1")
def _(t):
    meds = taken(t, "name").withColumn("status", F.when(F.col("l_returnflag") == "A", "CURRENT"))
    live = taken(t, "name").withColumn("status", F.when(F.col("l_linestatus") == "O", "ONGOING"))
    return cases.rule_pair(meds, live, patterns(t), "INSULIN", "FASTING", "HYPO")


@query("cas28_rule_condition", TAKEN + "SELECT client_id, 'PREGNANCY' AS rule_key, 'HOLD' AS severity, string_agg(DISTINCT name, '; ' ORDER BY name) AS detail FROM x WHERE p_name LIKE 'hot%' AND l_returnflag = 'R' GROUP BY 1")
def _(t):
    return cases.rule_condition(taken(t, "condition").withColumn("status", F.when(F.col("l_returnflag") == "R", "ACTIVE")), patterns(t), "PREGNANCY", "PREGNANCY")


@query("cas29_rule_renal", TAKEN + f", {CLASSES}" + "SELECT client_id, 'RENAL' AS rule_key, 'HOLD' AS severity, string_agg(DISTINCT name, '; ' ORDER BY name) AS detail FROM x JOIN m ON contains(p_name, pattern) AND match_class = 'RENAL' WHERE l_returnflag = 'N' GROUP BY 1")
def _(t):
    return cases.rule_condition(taken(t, "condition").withColumn("status", F.when(F.col("l_returnflag") == "N", "ACTIVE")), patterns(t), "RENAL", "RENAL")


@query("cas33_client_scope", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def _(t):
    return cases.scoped(t("orders", "o_custkey AS client_id", "o_orderkey"), 7).select("o_orderkey")


@query("pra03_adherence_bands", "SELECT CASE WHEN l_quantity > 45 THEN 'UNKNOWN' WHEN l_quantity * 2 >= 80 THEN 'HIGH' WHEN l_quantity * 2 >= 50 THEN 'PARTIAL' ELSE 'LOW' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem", "CASE WHEN l_quantity <= 45 THEN l_quantity * 2 END AS q").groupBy(X.adherence_band(F.col("q")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("pra05_map_totals", "SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1")
def _(t):
    n = t("orders", "o_custkey", "o_orderstatus").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    maps = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return maps.select("o_custkey", X.map_total(F.col("m")).alias("total"))


@query("pra08_practice_block", "SELECT l_suppkey AS strategy, count(DISTINCT l_orderkey) AS people, 'PRACTICE_OBSERVATION' AS basis FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1 ORDER BY people DESC, strategy LIMIT 20")
def _(t):
    rows = t("lineitem", "l_suppkey AS strategy", "l_orderkey").groupBy("strategy").agg(F.count_distinct("l_orderkey").alias("people"))
    return cases.practice_block(rows, t("supplier", "s_suppkey AS strategy", "s_acctbal").filter("s_acctbal > 0"))


@query("ops03_unpriced", "SELECT event_type AS model_name, CASE WHEN user_id % 2 = 0 THEN 'TEXT' END AS modality, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2")
def _(t):
    return telemetry.unpriced_spend(t("events", "event_type AS model_name", "CASE WHEN user_id % 2 = 0 THEN 'TEXT' END AS modality", "floor(value) AS input_tokens", "CASE WHEN event_id % 3 = 0 THEN 'UNPRICED' ELSE 'EXACT' END AS price_source"))


COSTS = "CAST(l_extendedprice AS DECIMAL(18,2))"


@query("ops04_call_measurement", f"SELECT o_orderkey AS run_id, count(l_orderkey) FILTER (WHERE l_orderkey IS NOT NULL) AS attempts, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, CAST(sum({COSTS}) AS DOUBLE) AS cost, count(*) FILTER (WHERE l_returnflag = 'R') AS errors FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    costs = t("lineitem", "l_orderkey AS run_id", "cast(l_quantity AS bigint) AS input_tokens", "cast(l_extendedprice AS decimal(18,2)) AS cost_usd", "l_returnflag <> 'R' AS success")
    return telemetry.call_measurement(t("orders", "o_orderkey AS run_id"), costs).filter("attempts > 0").select("run_id", "attempts", "tokens", "cost", "errors")


@query("ops06_run_clock", "SELECT CASE WHEN o_custkey % 3 = 0 THEN 'KNOWLEDGE' ELSE 'CASE' END AS clock, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return telemetry.run_clock(t("orders", "CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS client_id")).groupBy("clock").agg(F.count(F.lit(1)).alias("n"))


@query("ops07_incoherent_runs", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 7 = 0 THEN 'MODE_MISSING' WHEN o_orderstatus = 'P' THEN 'MODE_UNREGISTERED' WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'CLIENT_MISSING' WHEN o_orderstatus = 'F' AND o_custkey % 3 > 0 THEN 'CLIENT_UNEXPECTED' END AS reason FROM orders WHERE reason IS NOT NULL")
def _(t):
    runs = t("orders", "o_orderkey AS run_id", "'e' AS engine", "CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS engine_mode", "CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS client_id")
    registry = t("orders", "'e' AS engine", "o_orderstatus AS engine_mode", "o_orderstatus = 'O' AS needs_client").filter("engine_mode <> 'P'").distinct()
    return telemetry.incoherent_runs(runs, registry).select("run_id", "reason")


@query("ops12_blocks", "SELECT p_partkey, 'PART' AS tag, 'NAME=' || p_name || ' (' || p_type || ')|SIZE=' || p_size AS fields FROM part WHERE p_partkey % 4 > 0")
def _(t):
    rows = t("part", "p_partkey", "CASE WHEN p_partkey % 4 > 0 THEN 'said <PART>' || chr(10) || 'NAME: ' || p_name || chr(10) || ' (' || p_type || ')' || chr(10) || 'SIZE: ' || p_size || chr(10) || '</PART> end' ELSE 'none' END AS text")
    found = telemetry.extract_blocks(rows, ["PART"])
    return found.select("p_partkey", "tag", F.array_join(F.transform("fields", lambda x: F.concat(x["k"], F.lit("="), x["v"])), "|").alias("fields"))
