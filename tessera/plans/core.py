"""The library's operators on the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import cases, ingest, library, resolve, retrieval, sinks, telemetry

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (t, ) where t(name) reads a table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9%+/\\- ]', ' ', 'g'), '\\s+', ' ', 'g'))"
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^0-9a-z]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
SIM = "len(list_intersect({0}, {1})) * 1.0 / len(list_distinct(list_concat({0}, {1})))"


@query("nrm01_norm_phrase", f"SELECT p_partkey, {NORM.format('p_name')} AS phrase_norm FROM part")
def _(t):
    return t("part").select("p_partkey", X.norm_phrase(F.col("p_name")).alias("phrase_norm"))


@query("nrm01_norm_documents", f"SELECT doc_id, {NORM.format('text')} AS phrase_norm FROM documents")
def _(t):
    return t("documents").select("doc_id", X.norm_phrase(F.col("text")).alias("phrase_norm"))


KEY = "left(regexp_replace(upper(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), '^[^A-Z]+', ''), 80)"


@query("nrm02_canonical_key", f"SELECT p_partkey, CASE WHEN regexp_full_match({KEY.format('p_name')}, '[A-Z][A-Z0-9_]{{2,79}}') THEN {KEY.format('p_name')} END AS canonical_key FROM part")
def _(t):
    return t("part").select("p_partkey", X.canonical_key(F.col("p_name")).alias("canonical_key"))


@query(
    "nrm03_key_for",
    f"SELECT p_partkey, coalesce(CASE WHEN regexp_full_match({KEY.format('p_type')}, '[A-Z][A-Z0-9_]{{2,79}}') THEN {KEY.format('p_type')} END, 'PHRASE_' || upper(substring(sha256(p_type), 1, 12))) AS k, left({KEY.format('p_type')}, 73) || '_' || upper(substring(sha256(p_name), 1, 6)) AS other FROM part",
)
def _(t):
    k = X.key_for(F.col("p_type"))
    return t("part").select("p_partkey", k.alias("k"), X.disambiguate(k, F.col("p_name")).alias("other"))


@query("nrm04_trigrams", f"SELECT p_partkey, array_to_string(list_sort({GRAMS.format('p_name')}), '|') AS grams FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(F.array_sort(X.trigrams(F.col("p_name"))), "|").alias("grams"))


@query(
    "ont04_confusable_pairs",
    f"WITH g AS (SELECT p_partkey, p_brand, {GRAMS.format('p_name')} AS g FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_brand AS domain, round({SIM.format('a.g', 'b.g')}, 6) AS sim FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE {SIM.format('a.g', 'b.g')} BETWEEN 0.45 AND 0.85",
)
def _(t):
    c = t("part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("domain"))
    return resolve.generate_confusable(c).select("a", "b", "domain", F.round("sim", 6).alias("sim"))


@query(
    "ret08_nearest_vectors",
    "WITH q AS (SELECT vec_id AS q_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q_id, vec_id, round(greatest(0.0, list_inner_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS score FROM q, embeddings) SELECT q_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10",
)
def _(t):
    e = t("embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    return resolve.top_k(q, e, "q_id", "vec_id", 10)


@query("emb03_vector_audit", "SELECT vec_id, len(embedding) = 64 AS dims_ok, abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 1e-3 AS norm_ok FROM embeddings")
def _(t):
    return library.audit_vectors(t("embeddings"), 64).select("vec_id", "dims_ok", "norm_ok")


@query("emb01_stale_embeddings", "SELECT doc_id FROM documents WHERE trim(text) <> '' AND (doc_id % 3 = 0 OR doc_id % 3 = 1)")
def _(t):
    d = t("documents").withColumn("embedding", F.when(F.col("doc_id") % 3 != 0, F.array(F.lit(1.0))))
    d = d.withColumn("text_hash", F.when(F.col("doc_id") % 3 == 2, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.sha2(F.concat("text", F.lit(" ")), 256)))
    return library.stale_embeddings(d, "text").select("doc_id")


@query("emb02_coverage", "SELECT 'documents' AS table_name, count(*) AS n, 0 AS embedded, count(*) AS never FROM documents UNION ALL SELECT 'embeddings', count(*), count(embedding), count(*) - count(embedding) FROM embeddings")
def _(t):
    return library.embedding_coverage({"documents": t("documents").withColumn("embedding", F.lit(None).cast("array<float>")), "embeddings": t("embeddings")})


@query("emb05_embeddable", "SELECT doc_id, trim(text) <> '' AS ok FROM documents")
def _(t):
    return t("documents").select("doc_id", X.is_embeddable(F.col("text")).alias("ok"))


@query("ing21_token_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("ing13_redact_url", r"SELECT page_id, regexp_replace(url || '&token=abc', '([?&](?:api_key|apikey|key|token|access_token|auth|secret|password|signature|sig)=)[^&#]+', '\1REDACTED', 'gi') AS url FROM pages")
def _(t):
    return t("pages").select("page_id", X.redact_url(F.concat("url", F.lit("&token=abc"))).alias("url"))


@query("ing04_dedup_by_hash", "SELECT doc_id, CASE WHEN doc_id <> f THEN f END AS duplicate_of, CASE WHEN doc_id <> f THEN 'DEDUPED' ELSE 'NORMALIZED' END AS status FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents)")
def _(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return ingest.dedup_by_hash(d, "doc_id", "sha256", "doc_id").select("doc_id", "duplicate_of", "status")


@query("ing05_version_by_url", "SELECT page_id, CAST(row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1) ORDER BY page_id) AS INTEGER) AS source_version FROM pages")
def _(t):
    p = t("pages").withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    return ingest.version_by_url(p, "host", ["page_id"]).select("page_id", "source_version")


SECTIONS = (
    "WITH l AS (SELECT doc_id, i, CASE WHEN regexp_full_match(x, '\\w+\\.') THEN '# ' || x ELSE x END AS line FROM (SELECT doc_id, i, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))), "
    "h AS (SELECT *, regexp_matches(line, '^#\\s+\\S') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM h), "
    "b AS (SELECT doc_id, no, max(CASE WHEN head THEN trim(regexp_replace(line, '^#\\s+|\\s*#*\\s*$', '', 'g')) END) AS title, trim(coalesce(string_agg(line || chr(10), '' ORDER BY i) FILTER (WHERE NOT head), ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM s GROUP BY 1, 2), "
    "k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INTEGER) AS sec_no, coalesce(title, '(body)') AS location, CAST(length(body) AS INTEGER) AS n_chars FROM b WHERE body <> '') "
    "SELECT * FROM k UNION ALL SELECT doc_id, 0, '(body)', CAST(sum(length(line) + 1) - 1 AS INTEGER) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM k) GROUP BY doc_id"
)


@query("ing02_sections", SECTIONS)
def _(t):
    marked = F.regexp_replace("text", r"(?md)^(\w+\.)$", "# $1")
    return ingest.segment_sections(t("documents").select("doc_id", marked.alias("text")), "doc_id", "text").select("doc_id", "sec_no", "location", F.length("body").alias("n_chars"))


PACKED = (
    "WITH RECURSIVE a AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents), "
    "p AS (SELECT doc_id, i, length(ps[i]) AS n FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM a)), "
    "r AS (SELECT doc_id, i, n, 0 AS block, n + 2 AS size FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, p.n, CASE WHEN size + p.n > 2400 THEN block + 1 ELSE block END, CASE WHEN size + p.n > 2400 THEN p.n + 2 ELSE size + p.n + 2 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1), "
    "c AS (SELECT doc_id, block, sum(n) + 2 * (count(*) - 1) AS len, max(block) OVER (PARTITION BY doc_id) AS last FROM r GROUP BY 1, 2), d AS (SELECT doc_id, CASE WHEN block = last AND block > 0 AND len < 400 THEN block - 1 ELSE block END AS k, len FROM c) "
    "SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(sum(len) + 2 * (count(*) - 1) AS INTEGER) AS n_chars FROM d GROUP BY 1, 2"
)


@query("ing03_chunks", PACKED)
def _(t):
    d = t("documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("body"))
    return ingest.chunk_sections(d).select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"))


@query("ing06_kinds", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2') THEN source ELSE 'OTHER' END AS kind FROM documents")
def _(t):
    kinds = t("documents").filter("source in ('src0', 'src1', 'src2')").select(F.col("source").alias("kind"), F.lit(True).alias("active")).distinct()
    return ingest.resolve_kind(t("documents").withColumnRenamed("source", "declared_kind"), kinds).select("doc_id", "kind")


@query("ing09_unknown_items", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    known = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(None).cast("long").alias("o_orderkey"))
    known = known.unionByName(t("lineitem").filter("l_quantity > 45").select(F.lit(None).cast("long").alias("o_custkey"), F.col("l_orderkey").alias("o_orderkey")))
    new = t("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderkey")
    return ingest.filter_unknown(new, known, "id", {"customer": "o_custkey", "order": "o_orderkey"}).select("o_orderkey")


@query("ing10_since_cursor", "WITH c AS (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS cur FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN c USING (o_custkey) WHERE cur IS NULL OR o_orderkey < cur")
def _(t):
    entries = t("orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("guid"), F.col("o_orderkey").alias("pos"))
    cursors = t("orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("source")).agg(F.min("o_orderkey").alias("cursor"))
    return ingest.entries_since_cursor(entries, cursors).select(F.col("guid").alias("o_orderkey"))


CAPTIONS = (
    "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS words, list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) AS plain FROM conversations), "
    "p AS (SELECT *, lag(plain) OVER o AS prev, lag(turn + 1.5) OVER o AS ended FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn)), "
    "q AS (SELECT *, coalesce(turn < ended - 0.01, false) AS time_overlap, coalesce(list_max(list_filter(range(1, least(len(prev), len(plain)) + 1), lambda k: list_slice(prev, len(prev) - k + 1, len(prev)) = list_slice(plain, 1, k))), 0) AS fits FROM p), "
    "d AS (SELECT *, CAST(CASE WHEN time_overlap THEN fits ELSE 0 END AS INTEGER) AS dropped_words FROM q) SELECT conv_id, turn, dropped_words, time_overlap, coalesce(array_to_string(list_slice(words, dropped_words + 1, len(words)), ' '), '') AS text FROM d"
)


@query("ing14_caption_overlap", CAPTIONS)
def _(t):
    c = t("conversations").select("conv_id", "turn", "text", F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.5).alias("end"))
    return ingest.dedupe_segments(c, "conv_id", "turn").select("conv_id", "turn", "dropped_words", "time_overlap", "text")


BLOCKS = (
    "WITH RECURSIVE s AS (SELECT conv_id, length(text) AS n, CAST(turn AS DOUBLE) AS began, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations WHERE trim(text) <> ''), "
    "r AS (SELECT conv_id, i, 0 AS block_no, began AS start, n AS size FROM s WHERE i = 1 UNION ALL SELECT s.conv_id, s.i, CASE WHEN size + 1 + n > 1200 THEN block_no + 1 ELSE block_no END, CASE WHEN size + 1 + n > 1200 THEN began ELSE start END, CASE WHEN size + 1 + n > 1200 THEN n ELSE size + 1 + n END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1) "
    "SELECT conv_id, CAST(block_no AS INTEGER) AS block_no, start, CAST(max(size) AS INTEGER) AS n_chars FROM r GROUP BY 1, 2, 3"
)


@query("ing15_blocks", BLOCKS)
def _(t):
    c = t("conversations").select("conv_id", F.col("turn").cast("double").alias("start"), "text")
    return ingest.pack_blocks(c, "conv_id").select("conv_id", "block_no", "start", F.length("text").alias("n_chars"))


@query("ing19_discovery_state", "SELECT c_mktsegment AS adapter, coalesce(searches, 0) AS searches, coalesce(items_new, 0) AS items_new, coalesce(fetched, 0) AS fetched, coalesce(refused, 0) AS refused FROM (SELECT DISTINCT c_mktsegment FROM customer) LEFT JOIN (SELECT c_mktsegment, count(*) AS searches, sum(o_orderkey % 3) AS items_new FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (c_mktsegment) LEFT JOIN (SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS fetched, count(*) FILTER (WHERE o_orderstatus <> 'F') AS refused FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (c_mktsegment)")
def _(t):
    seg = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("adapter"))
    o = t("orders").join(seg, "o_custkey")
    q = o.select("adapter", (F.col("o_orderkey") % 3).alias("items_new"), F.col("o_orderdate").alias("at"))
    f = o.select("adapter", F.when(F.col("o_orderstatus") == "F", "FETCHED").otherwise("REFUSED").alias("outcome"), F.col("o_orderdate").alias("at"))
    return ingest.discovery_state(seg.select("adapter").distinct().withColumn("active", F.lit(True)), q, f).drop("last_activity")


@query("snk01_upsert", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    target = t("customer").select("c_custkey", "c_acctbal")
    new = t("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return sinks.upsert(target, new, ["c_custkey"])


@query("snk02_insert_absent", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    return sinks.insert_absent(t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), t("orders").select("o_custkey"), ["o_custkey"])


@query("snk04_replace_owner", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2 FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1")
def _(t):
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    owners = line.filter("l_orderkey % 7 = 0")
    return sinks.replace_owner(line, owners.filter("l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") * 2), "l_orderkey", owners)


def text_hits(t):
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = asked.select(F.explode(retrieval.lexemes(F.col("text"))).alias("lexeme"))
    return retrieval.by_fts(asked, retrieval.postings(t("documents"), "DOCUMENT", "doc_id", "text", "source", words))


STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
LEX = f"list_filter(regexp_split_to_array(lower({{0}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: w <> '' AND w NOT IN ({STOPS}))"
FTS = (
    f"WITH ix AS (SELECT doc_id, source, lexeme, count(*) AS tf FROM (SELECT doc_id, source, unnest({LEX.format('text')}) AS lexeme FROM documents) GROUP BY ALL), "
    f"q AS (SELECT item_id, unnest(list_distinct({LEX.format('text')})) AS lexeme FROM benchmark), "
    "h AS (SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS id, source AS bucket, CAST(sum(tf) AS DOUBLE) AS raw FROM ix JOIN q USING (lexeme) GROUP BY 1, 2, 3) "
)


@query("ret06_text_channel", FTS + "SELECT query_id, 'DOCUMENT' AS kind, id, bucket, 'fts' AS channel, raw FROM h")
def _(t):
    return text_hits(t)


PAGE = (
    FTS
    + ", s AS (SELECT query_id, id, bucket, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM h), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, id) > 20 AS deferred FROM s), "
    "page AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY deferred, score DESC, id) AS INTEGER) AS rank FROM p) WHERE rank <= 20) "
)


@query("ret14_page", PAGE + "SELECT query_id, id, score, bucket, deferred, rank FROM page")
def _(t):
    return retrieval.retrieve(text_hits(t), 20, 1).select("query_id", "id", "score", F.col("buckets")[0].alias("bucket"), "deferred", "rank")


PAGE4 = PAGE.replace("> 20 AS deferred", "> 4 AS deferred")


@query("evl04_recall", PAGE4 + ", e AS (SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS want FROM benchmark) SELECT query_id, round(CAST(max(CASE WHEN bucket = want THEN 1 ELSE 0 END) AS DOUBLE), 4) AS recall FROM e LEFT JOIN page USING (query_id) GROUP BY 1")
def _(t):
    tests = t("benchmark").select(F.col("item_id").alias("query_id"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("expected"))
    return retrieval.concept_recall(retrieval.retrieve(text_hits(t), 20, 5), tests)


@query("evl05_breadth", PAGE4 + "SELECT query_id, round(count(DISTINCT bucket) * 1.0 / (SELECT count(DISTINCT source) FROM documents), 4) AS breadth FROM page GROUP BY 1")
def _(t):
    domains = t("documents").select(F.col("source").alias("bucket"), F.col("source").alias("domain")).distinct()
    return retrieval.domain_breadth(retrieval.retrieve(text_hits(t), 20, 5), domains)


@query("ret16_hits", PAGE4 + "SELECT bucket AS concept_id, count(DISTINCT query_id) AS retrieval_hits FROM page GROUP BY 1")
def _(t):
    return retrieval.record_hits(retrieval.retrieve(text_hits(t), 20, 5))


@query("evl08_discovery_value", "SELECT source, count(*) AS presented, count(quality) AS decided, count(*) FILTER (WHERE quality = 1) AS useful, round(count(*) FILTER (WHERE quality = 1) * 1.0 / nullif(count(quality), 0), 4) AS useful_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    d = t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left")
    return retrieval.discovery_value(d.withColumn("verdict", F.when(F.col("quality") == 1, "USEFUL").when(F.col("quality") == 0, "NOISE")), ["source"])


@query("evl09_discovery_trend", "SELECT date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS presented, count(*) FILTER (WHERE event_type <> 'error') AS decided, count(*) FILTER (WHERE event_type = 'purchase') AS useful, round(count(*) FILTER (WHERE event_type = 'purchase') * 1.0 / count(*) FILTER (WHERE event_type <> 'error'), 4) AS useful_rate FROM events GROUP BY 1")
def _(t):
    e = t("events").withColumn("month", F.date_trunc("month", "ts"))
    return retrieval.discovery_value(e.withColumn("verdict", F.when(F.col("event_type") == "purchase", "USEFUL").when(F.col("event_type") != "error", "OTHER")), ["month"])


def as_calls(t):
    """Events as calls: the type is the operation, k of props the model, value the tokens."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = t("events").select(F.col("event_id").alias("call_id"), F.col("ts").alias("occurred_at"), F.col("event_type").alias("operation"), (F.col("user_id") % 3).cast("string").alias("model_role"), "user_id", "value", k.alias("k"))
    return e.withColumn("input_tokens", F.floor("value")).withColumn("success", F.col("operation") != "error").withColumn("duration_ms", F.col("value")).withColumn("cost_usd", F.col("value") / 1000)


@query("ops01_cost_by_operation", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS operation, CAST(user_id % 3 AS VARCHAR) AS model_role, count(*) AS calls, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, CAST(round(sum(CAST(value / 1000 AS DECIMAL(28,12))), 6) AS DOUBLE) AS cost, floor(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value) * 10000 + 0.5) / 10000 AS avg_ms, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1, 2, 3")
def _(t):
    return telemetry.cost_by_operation(as_calls(t))


@query(
    "ops02_price_calls",
    "WITH m AS (SELECT event_id, event_type || '-' || CAST(user_id % 5 AS VARCHAR) AS model, CAST(floor(value) AS BIGINT) AS tok FROM events), p(pm, r) AS (VALUES ('click', 0.5), ('click-3', 0.7), ('purchase-1', 2.0), ('view', 0.1)), h AS (SELECT event_id, tok, r, pm = model AS ex, row_number() OVER (PARTITION BY event_id ORDER BY pm = model DESC, length(pm) DESC) AS rn FROM m JOIN p ON starts_with(model, pm)) SELECT m.event_id AS call_id, CASE WHEN r IS NULL THEN 'UNPRICED' WHEN ex THEN 'EXACT' ELSE 'PREFIX' END AS price_source, CAST(round(m.tok * CAST(r AS DECIMAL(12,6)), 0) AS DOUBLE) / 1e6 AS cost_usd FROM m LEFT JOIN h ON m.event_id = h.event_id AND rn = 1",
)
def _(t):
    calls = as_calls(t).withColumn("model_name", F.concat("operation", F.lit("-"), (F.col("user_id") % 5).cast("string"))).withColumn("output_tokens", F.lit(0)).withColumn("modality", F.lit("TEXT")).drop("cost_usd")
    rates = [("click", 0.5), ("click-3", 0.7), ("purchase-1", 2.0), ("view", 0.1)]
    prices = calls.sparkSession.createDataFrame([(m, "TEXT", r, 0.0) for m, r in rates], "model_name string, modality string, in_rate double, out_rate double")
    return telemetry.price_calls(calls, prices).select("call_id", "price_source", "cost_usd")


@query("ops10_dead_letters", "SELECT l_returnflag AS job, l_linestatus AS entity_type, count(*) AS failures, count(*) FILTER (WHERE l_discount > 0.05) AS open, count(*) FILTER (WHERE l_tax < 0.02) AS without_client, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1, 2")
def _(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("job"), F.col("l_linestatus").alias("entity_type"), F.when(F.col("l_discount") <= 0.05, F.lit(1)).alias("resolved_at"), F.when(F.col("l_tax") >= 0.02, F.lit(1)).alias("client_id"), F.col("l_shipdate").alias("failed_at"))
    return telemetry.dead_letter_triage(rows)


@query("ops11_budget", "SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, CAST(round(sum(CAST(value / 1000 AS DECIMAL(28,12))), 6) AS DOUBLE) AS cost, round(greatest(0.0, 20.0 - CAST(round(sum(CAST(value / 1000 AS DECIMAL(28,12))), 6) AS DOUBLE)), 6) AS remaining FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def _(t):
    return telemetry.budget_remaining(telemetry.spend_by_day(as_calls(t).withColumn("client_work", F.col("user_id") % 2 == 1)), 20.0)


@query("ops05_run_health", "SELECT o_orderstatus AS engine, left(o_orderpriority, 1) AS pass, CASE WHEN o_totalprice > 100000 THEN 'BIG' ELSE 'SMALL' END AS status, count(*) AS runs, round(avg(o_totalprice), 4) AS avg_ms, CAST(sum(o_custkey % 4) AS BIGINT) AS attempts FROM orders GROUP BY 1, 2, 3")
def _(t):
    return telemetry.run_health(t("orders").select(F.col("o_orderstatus").alias("engine"), F.left("o_orderpriority", F.lit(1)).alias("pass"), F.when(F.col("o_totalprice") > 100000, "BIG").otherwise("SMALL").alias("status"), F.col("o_totalprice").alias("duration_ms"), (F.col("o_custkey") % 4).alias("attempts")))


@query("ops09_two_pass", "SELECT l_orderkey AS cycle_id, count(DISTINCT l_returnflag) AS hashes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def _(t):
    return telemetry.two_pass_audit(t("lineitem").select(F.col("l_orderkey").alias("cycle_id"), F.col("l_returnflag").alias("prompt_hash")))


@query("ops15_integrity", "SELECT 'lineitem' AS \"table\", 'quantity' AS rule, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem WHERE NOT l_quantity <= 49 UNION ALL SELECT 'orders', 'price', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT o_totalprice >= 2000")
def _(t):
    return telemetry.integrity_audit({"lineitem": (t("lineitem"), "l_orderkey", {"quantity": "l_quantity <= 49"}), "orders": (t("orders"), "o_orderkey", {"price": "o_totalprice >= 2000"})})


@query("cas11_latest_order", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return cases.latest(t("orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("cas12_timeline", "SELECT o_custkey AS client_id, o_orderdate AS at, 'ORDER' AS kind, o_orderstatus AS detail FROM orders UNION ALL SELECT o_custkey, l_shipdate, 'SHIPMENT', l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    ship = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return cases.timeline({"ORDER": (t("orders"), "o_custkey", "o_orderdate", "o_orderstatus"), "SHIPMENT": (ship, "o_custkey", "l_shipdate", "l_linestatus")})


@query("cas13_versions", "SELECT o_custkey AS client_id, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS version, lead(o_orderkey) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR))")
def _(t):
    new = t("orders").select(F.col("o_custkey").alias("client_id"), "o_orderkey", F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").cast("string").alias("state"))
    none = new.limit(0).withColumn("version", F.lit(1)).withColumn("is_current", F.lit(True))
    return cases.append_versions(new, none).select("client_id", "o_orderkey", "version", "is_current")


@query("cas19_outcome_fold", "SELECT event_id, old_value FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events) WHERE old_value IS DISTINCT FROM event_type")
def _(t):
    return cases.fold_outcomes(t("events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "old_value")


@query(
    "cas31_rule_flags",
    "WITH last AS (SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1), f AS (SELECT o_custkey AS client_id, 'PRICE' AS rule_key, 'HOLD' AS severity FROM last WHERE o_totalprice < 20000 OR o_totalprice > 400000 UNION ALL SELECT o_custkey, 'WORSENING', 'NOTE' FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT f.* FROM f WHERE NOT (rule_key = 'PRICE' AND client_id % 10 = 0)",
)
def _(t):
    o = t("orders").withColumnRenamed("o_custkey", "client_id")
    last = cases.latest(o, ["client_id"], ["o_orderdate", "o_orderkey"], ["o_totalprice"]).select("client_id", F.lit(" price").alias("marker"), F.col("o_totalprice").alias("value"))
    limits = o.sparkSession.createDataFrame([("PRICE", "PRICE", 20000.0, 400000.0, True)], "marker string, rule_key string, critical_low double, critical_high double, active boolean")
    worse = o.filter("o_orderstatus = 'P'").select("client_id", F.lit("WORSENING").alias("outcome"), F.lit("ONGOING").alias("status"), F.col("o_orderpriority").alias("name"))
    flags = t("customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("client_id"), F.lit("PRICE").alias("rule_key"), F.lit("OPEN").alias("status"))
    return cases.apply_rules([cases.rule_critical(last, limits), cases.rule_worsening(worse)], flags).select("client_id", "rule_key", "severity")


@query("cas08_supersede", "SELECT o_orderkey, CASE WHEN rn > 1 AND o_orderstatus = 'O' THEN 'SUPERSEDED' WHEN o_orderstatus = 'O' THEN 'SUBMITTED' ELSE o_orderstatus END AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)")
def _(t):
    s = t("orders").select(F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "SUBMITTED").otherwise(F.col("o_orderstatus")).alias("status"))
    return cases.supersede(s).select(F.col("submission_id").alias("o_orderkey"), "status")


@query("cas23_release", "SELECT c_custkey AS client_id, count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS open_holds, bool_or(coalesce(o_orderpriority = '1-URGENT', false)) AS approved, count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') = 0 AND bool_or(coalesce(o_orderpriority = '1-URGENT', false)) AS ready FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(t):
    o = t("orders").withColumnRenamed("o_custkey", "client_id")
    flags = o.filter("o_orderstatus = 'P'").select("client_id", F.lit("OPEN").alias("status"), F.lit("HOLD").alias("severity"))
    return cases.release_readiness(t("customer").select(F.col("c_custkey").alias("client_id")), flags, o.filter("o_orderpriority = '1-URGENT'").select("client_id", F.lit("APPROVED").alias("decision")))


def exposures(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_partkey") % 400).alias("strategy"), F.col("o_custkey").alias("client_id"), (F.col("o_orderstatus") != "O").alias("assessed"), F.col("l_shipdate").alias("started"),
        F.col("l_shipdate").alias("recorded_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("intervention_id"), F.col("l_returnflag").alias("outcome"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity") * 2).alias("adherence"),
    )


EXPO = "WITH x AS (SELECT l_partkey % 400 AS strategy, o_custkey AS client_id, o_orderstatus <> 'O' AS assessed, l_shipdate AS started, l_orderkey * 10 + l_linenumber AS iid, l_returnflag AS outcome, CASE WHEN l_linenumber > 1 THEN l_quantity * 2 END AS adherence FROM lineitem JOIN orders ON l_orderkey = o_orderkey) "


@query("pra01_cohorts", EXPO + "SELECT strategy, count(DISTINCT client_id) AS exposed, count(DISTINCT CASE WHEN assessed THEN client_id END) AS assessed, count(*) AS interventions, min(started) AS first_start, max(started) AS last_start, count(DISTINCT CASE WHEN assessed THEN client_id END) >= 5 AS meets, CASE WHEN count(DISTINCT CASE WHEN assessed THEN client_id END) < 5 THEN CAST(count(DISTINCT CASE WHEN assessed THEN client_id END) AS VARCHAR) || ' of 5 needed' END AS blocked FROM x GROUP BY 1")
def _(t):
    return cases.cohort_candidates(exposures(t))


OBS = EXPO + ", o AS (SELECT strategy, client_id, outcome, adherence, CASE WHEN adherence IS NULL THEN 'UNKNOWN' WHEN adherence >= 80 THEN 'HIGH' WHEN adherence >= 50 THEN 'PARTIAL' ELSE 'LOW' END AS band FROM (SELECT *, row_number() OVER (PARTITION BY strategy, client_id ORDER BY started DESC, iid DESC) AS rn FROM x) WHERE rn = 1) "


@query("pra02_observations", OBS + "SELECT strategy, client_id, outcome, adherence FROM o")
def _(t):
    return cases.observations(exposures(t))


@query(
    "pra04_summary",
    OBS + ", n1 AS (SELECT strategy, string_agg(outcome || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, outcome) AS outcome_counts, CAST(sum(n) AS BIGINT) AS people FROM (SELECT strategy, outcome, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1), n2 AS (SELECT strategy, string_agg(band || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, band) AS band_counts FROM (SELECT strategy, band, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1), n3 AS (SELECT strategy, 2 * count(*) FILTER (WHERE band = 'UNKNOWN') > count(*) AS mostly_unknown FROM o GROUP BY 1) SELECT * FROM n1 JOIN n2 USING (strategy) JOIN n3 USING (strategy) WHERE people >= 5",
)
def _(t):
    return cases.cohort_summary(cases.observations(exposures(t)))


@query("pra06_identifiers", r"SELECT * FROM (SELECT doc_id, regexp_matches(text, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') AS has_uuid, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email, regexp_matches(text, '\+?[0-9]{3}[-. ][0-9]{3,4}[-. ][0-9]{4}') AS has_phone FROM documents) WHERE has_uuid OR has_email OR has_phone")
def _(t):
    return cases.scan_identifiers(t("documents"), "doc_id", "text")


@query("pra07_diff", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN a.n IS NULL THEN 'CREATED' WHEN b.n IS NULL THEN 'GONE' WHEN a.n = b.n THEN 'UNCHANGED' ELSE 'UPDATED' END AS change FROM a FULL JOIN b USING (o_custkey)")
def _(t):
    n = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return cases.diff_aggregates(n(t("orders").filter("o_orderdate < '1997-01-01'")), n(t("orders")), "o_custkey", ["n"])


@query("knw16_gap_queue", "SELECT l_orderkey * 10 + l_linenumber AS gap_id, CASE l_returnflag WHEN 'A' THEN 'CRITICAL' WHEN 'N' THEN 'HIGH' ELSE 'LOW' END AS severity, coalesce(n, 0) AS strategies FROM lineitem LEFT JOIN (SELECT ps.l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ps GROUP BY 1) s USING (l_suppkey) WHERE l_linestatus = 'O'")
def _(t):
    line = t("lineitem")
    gaps = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gap_id"), F.col("l_suppkey").alias("domain"), F.when(F.col("l_linestatus") == "O", "OPEN").alias("status"), F.when(F.col("l_returnflag") == "A", "CRITICAL").when(F.col("l_returnflag") == "N", "HIGH").otherwise("LOW").alias("severity"), F.col("l_quantity").alias("importance"), F.col("l_shipdate").alias("raised_at"))
    return library.gap_queue(gaps, line.select(F.col("l_suppkey").alias("domain"), "l_partkey").distinct()).select("gap_id", "severity", "strategies")


@query("knw23_readiness", "WITH n AS (SELECT l_suppkey, p_brand, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT l_suppkey, count(*) FILTER (WHERE n >= 20) AS covered, coalesce(string_agg(CASE WHEN n < 20 THEN p_brand END, ',' ORDER BY p_brand), '') AS missing, count(*) FILTER (WHERE n >= 20) >= 14 AS deep FROM n GROUP BY 1")
def _(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return library.readiness(rows, "l_suppkey", "p_brand", "l_partkey", 20, library.DEPTH)


@query("knw25_floors", "SELECT metric, n, CAST(floor AS BIGINT) AS floor, n >= floor AS met FROM (SELECT 'parts' AS metric, count(*) AS n, 1000 AS floor FROM part UNION ALL SELECT 'suppliers', count(*), 5000 FROM supplier UNION ALL SELECT 'orders', count(*), 100 FROM orders)")
def _(t):
    return library.floors({"parts": (t("part"), 1000), "suppliers": (t("supplier"), 5000), "orders": (t("orders"), 100)})


@query("knw26_provenance", "SELECT lang, count(*) AS total, count(quality) AS with_source, count(*) - count(quality) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    return library.provenance_audit(t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left"), "lang", "quality")


@query("knw27_quality", "SELECT 'customer without orders' AS issue, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'part without lines', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'negative balance', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0")
def _(t):
    return library.quality_issues({
        "customer without orders": (t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "c_custkey"),
        "part without lines": (t("part").join(t("lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_anti"), "p_partkey"),
        "negative balance": (t("supplier").filter("s_acctbal < 0"), "s_suppkey"),
    })


@query("knw34_progress", "WITH l AS (SELECT *, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM (SELECT * FROM events)) SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS passes, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'error' AND (last IS NULL OR event_id > last)) AS failing, count(*) FILTER (WHERE event_type = 'error' AND (last IS NULL OR event_id > last)) >= 3 AS paused FROM l GROUP BY 1")
def _(t):
    return library.fold_progress(t("events").withColumn("ok", F.col("event_type") != "error"), "user_id", "ok", ["event_id"])


CANDIDATES = "WITH n AS (SELECT o_custkey AS claim_id, s.l_suppkey AS strategy_id, count(DISTINCT c.l_partkey) AS shared FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) c JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) s USING (l_partkey) GROUP BY 1, 2) SELECT claim_id, strategy_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY shared DESC, strategy_id) AS rn FROM n) WHERE rn <= 8"


@query("knw09_candidates", CANDIDATES)
@query("knw09_candidates_of_all", CANDIDATES)
def _(t):
    """All claims; both names are kept."""
    line = t("lineitem")
    claims = line.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("claim_id"), F.col("l_partkey").alias("concept_id"))
    return library.candidate_strategies(line.select(F.col("l_suppkey").alias("strategy_id"), F.col("l_partkey").alias("concept_id")), claims)


HEADINGS = (
    "WITH d AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_full_match(x, '\\w+\\.') THEN '## ' || x ELSE x END), chr(10)) AS t FROM documents), "
    "l AS (SELECT doc_id, t, i, string_split(t, chr(10))[i] AS line FROM (SELECT doc_id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)), "
    "s AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM l) "
    "SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, CAST(length(regexp_extract(line, '^(#{1,6})', 1)) AS INTEGER) AS level, trim(regexp_replace(line, '^#{1,6}\\s+', '')) AS heading, a AS start, least(a + length(line) + 1, length(t)) AS body, coalesce(lead(a) OVER w, length(t)) AS \"end\" FROM s WHERE regexp_matches(line, '^#{1,6}\\s+\\S') WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
)


@query("cur01_headings", HEADINGS)
def _(t):
    marked = F.regexp_replace("text", r"(?md)^(\w+\.)$", "## $1")
    return library.heading_blocks(t("documents").select("doc_id", marked.alias("text")), "doc_id", "text")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries: text channel over documents and vector channel over embeddings, merged and reranked."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    v = t("embeddings")
    q = t("benchmark").join(v, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
    docs = v.select(F.col("vec_id").alias("id"), "embedding").join(t("documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return retrieval.retrieve(text_hits(t).unionByName(retrieval.by_vector(q, docs, "DOCUMENT", "source", 20)), 20, 5)
