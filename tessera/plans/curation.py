"""Evidence, decisions, curated cards and contracts on the given tables, each query with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import curation, foundation, library, resolve, retrieval
from tessera.plans import core, resolver
from tessera.plans.core import GRAMS, PAGE, SIM
from tessera.plans.resolver import ONTOLOGY, STRICT
from tessera.plans.states import collector

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = collector(QUERIES, ORACLE)


@query(
    "knw06_evidence",
    "WITH l AS (SELECT l_orderkey AS claim_id, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE 'study ' || l_partkey || '/' || l_linenumber || '/' || l_suppkey END AS citation, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM lineitem), "
    "i AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_partkey % 2 = 0 THEN '10.1/p' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END AS pmid FROM part), "
    "x AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN '10.1/P' || l_partkey END AS doi, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_partkey AS VARCHAR) END AS pmid, CASE WHEN l_linenumber = 1 THEN 'http://x/' || l_suppkey END AS url FROM l WHERE trim(citation) <> '') "
    "SELECT claim_id, citation, CASE l_returnflag WHEN 'A' THEN 'RCT' ELSE 'OTHER' END AS design, CASE l_returnflag WHEN 'N' THEN 'LIMITS' ELSE 'NEUTRAL' END AS relationship, CASE WHEN l_linenumber % 4 <> 1 THEN CAST(1990 + l_linenumber AS BIGINT) END AS publication_year, "
    "coalesce(a.item_id, b.item_id) AS item_id, CASE WHEN coalesce(a.item_id, b.item_id) IS NOT NULL THEN 'KNOWN' WHEN x.doi IS NOT NULL OR x.pmid IS NOT NULL OR url IS NOT NULL THEN 'NEW' ELSE 'NONE' END AS study FROM x LEFT JOIN i a ON lower(x.doi) = a.doi LEFT JOIN i b ON x.pmid = b.pmid",
)
def _(t):
    rows = t("lineitem", "l_orderkey AS claim_id", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey").selectExpr(
        "claim_id", "CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE 'study ' || l_partkey || '/' || l_linenumber || '/' || l_suppkey END AS citation", "CASE l_returnflag WHEN 'A' THEN ' rct' ELSE 'unheard of' END AS design",
        "CASE l_returnflag WHEN 'N' THEN 'limits' WHEN 'R' THEN 'odd' END AS relationship", "1990 + l_linenumber AS publication_year", "l_linenumber % 4 = 1 AS told", "CASE WHEN l_linenumber % 2 = 0 THEN '10.1/P' || l_partkey END AS doi",
        "CASE WHEN l_linenumber % 3 = 0 THEN cast(l_partkey AS string) END AS pmid", "CASE WHEN l_linenumber = 1 THEN 'http://x/' || l_suppkey END AS url",
    )
    record = F.to_json(F.struct("citation", "design", "relationship", "publication_year", "doi", "pmid", "url"))
    record = F.when(F.col("told"), F.regexp_replace(record, r'("publication_year":)(\d+)', '$1"$2"')).otherwise(record)
    raw = rows.select("claim_id", record.alias("r")).groupBy("claim_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("records"))
    items = t("part", "cast(p_partkey AS string) AS item_id", "CASE WHEN p_partkey % 2 = 0 THEN '10.1/p' || p_partkey END AS doi", "CASE WHEN p_partkey % 3 = 0 THEN cast(p_partkey AS string) END AS pmid", "cast(null AS string) AS url")
    return curation.land_evidence(raw, items).select("claim_id", "citation", "design", "relationship", "publication_year", "item_id", "study")


DECIDED = (
    ONTOLOGY + ", st AS (SELECT CAST(concept_id AS VARCHAR) AS strategy_id, canonical_name AS name, canonical_key AS k, 'old' AS summary, CASE WHEN concept_id % 4 = 0 THEN 'm' END AS mechanism, 'LIMITED' AS evidence_confidence, 'APPROVED' AS knowledge_status FROM concepts WHERE concept_id % 2 = 0), "
    "d AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'NO_CHANGE' ELSE 'OTHER' END AS decision, c.canonical_name AS name, c.canonical_key AS k, CAST(c.concept_id AS VARCHAR) AS sid, CASE WHEN o_orderkey % 3 <> 0 THEN 's' || o_orderkey END AS summary, CASE WHEN o_orderkey % 5 = 0 THEN 'm' || o_orderkey END AS mechanism FROM orders JOIN concepts c ON c.concept_id = o_custkey), "
    f"ng2 AS (SELECT k, {GRAMS.format('name')} AS h FROM (SELECT DISTINCT k, name FROM d) WHERE k NOT IN (SELECT k FROM st)), sg AS (SELECT strategy_id, {GRAMS.format('name')} AS g FROM st), "
    f"hk AS (SELECT k, strategy_id AS hit FROM st UNION ALL SELECT k, hit FROM (SELECT k, strategy_id AS hit, row_number() OVER (PARTITION BY k ORDER BY {SIM.format('g', 'h')} DESC, CAST(strategy_id AS BIGINT)) AS rn FROM ng2, sg WHERE {SIM.format('g', 'h')} >= 0.92) WHERE rn = 1), "
    "h AS (SELECT d.*, hit, min(CASE WHEN d.decision = 'CREATE' AND hit IS NULL THEN id END) OVER (PARTITION BY d.k) AS first FROM d LEFT JOIN hk USING (k)), "
    "o AS (SELECT *, CASE WHEN decision = 'CREATE' THEN coalesce(hit, 'new-' || first) WHEN decision = 'UPDATE' THEN sid END AS target, CASE WHEN decision = 'CREATE' AND hit IS NULL AND id = first THEN 'CREATE' WHEN decision = 'CREATE' THEN 'UPDATE' WHEN decision = 'UPDATE' AND sid IN (SELECT strategy_id FROM st) THEN 'UPDATE' WHEN decision = 'NO_CHANGE' THEN 'NO_CHANGE' ELSE 'REFUSED' END AS outcome FROM h) "
)


def strategies(t):
    c = resolver.concepts(t).filter("concept_id % 2 = 0")
    return c.selectExpr("cast(concept_id AS string) AS strategy_id", "canonical_name AS name", "canonical_key AS strategy_key", "'old' AS summary", "CASE WHEN concept_id % 4 = 0 THEN 'm' END AS mechanism", "'LIMITED' AS evidence_confidence", "'APPROVED' AS knowledge_status")


def decisions(t):
    c = resolver.concepts(t).select(F.col("concept_id").alias("o_custkey"), "canonical_name", "canonical_key")
    rows = t("orders", "o_orderkey", "o_custkey").join(c, "o_custkey")
    return rows.selectExpr(
        "o_orderkey AS decision_id", "CASE o_orderkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'UPDATE ' WHEN 2 THEN 'NO_CHANGE' ELSE 'OTHER' END AS decision", "canonical_name AS name", "canonical_key AS strategy_key",
        "cast(o_custkey AS string) AS strategy_id", "'?' AS evidence_confidence", "CASE WHEN o_orderkey % 3 <> 0 THEN 's' || o_orderkey END AS summary", "CASE WHEN o_orderkey % 5 = 0 THEN 'm' || o_orderkey END AS mechanism",
    )


def decided(t):
    d, s = decisions(t), strategies(t)
    hits = foundation.collisions(d.select(F.col("decision_id").alias("name_id"), "name", "strategy_key"), s).select(F.col("name_id").alias("decision_id"), "strategy_id")
    return curation.apply_decisions(d, s.drop("strategy_key"), hits, ["summary", "mechanism"])


@query("knw11_outcomes", DECIDED + "SELECT id AS decision_id, target AS strategy_id, outcome FROM o")
def _(t):
    return decided(t)[1]


@query(
    "knw11_strategies",
    DECIDED + ", said AS (SELECT target AS strategy_id, max_by(summary, id) FILTER (WHERE summary IS NOT NULL) AS summary, max_by(mechanism, id) FILTER (WHERE mechanism IS NOT NULL) AS mechanism, max(CASE WHEN outcome = 'CREATE' THEN name END) AS name FROM o WHERE outcome IN ('CREATE', 'UPDATE') GROUP BY 1) "
    "SELECT strategy_id, coalesce(st.name, said.name) AS name, coalesce(said.summary, st.summary) AS summary, coalesce(said.mechanism, st.mechanism) AS mechanism, coalesce(evidence_confidence, 'UNKNOWN') AS evidence_confidence, coalesce(knowledge_status, 'AI_DISCOVERED_CANDIDATE') AS knowledge_status FROM st FULL JOIN said USING (strategy_id)",
)
def _(t):
    return decided(t)[0].select("strategy_id", "name", "summary", "mechanism", "evidence_confidence", "knowledge_status")


LINKED = STRICT + ", l AS (SELECT DISTINCT p_partkey AS strategy_id, unnest(string_split(concept_ids, ',')) AS concept_id, CASE p_partkey % 3 WHEN 0 THEN 'MECHANISM' ELSE 'TARGETS' END AS link_role FROM ph JOIN done USING (phrase_norm) WHERE outcome = 'RESOLVED') "


def linked(t):
    done = resolve.resolve(resolver.phrases(t), resolver.tiers(t), resolver.relations(t))
    done = done.select("phrase_norm", F.when(F.col("outcome") == "RESOLVED", F.col("concept_ids")).alias("concept_ids"))
    rows = resolver.parts(t).selectExpr("p_partkey AS strategy_id", "phrase", "CASE p_partkey % 3 WHEN 0 THEN 'mechanism' WHEN 1 THEN 'odd' END AS role")
    have = resolver.parts(t).filter("p_partkey % 10 = 0").selectExpr("p_partkey AS strategy_id", "p_partkey AS concept_id", "'TARGETS' AS link_role")
    return curation.link_concepts(rows, done, have)


@query("knw13_links", LINKED + "SELECT strategy_id, CAST(concept_id AS BIGINT) AS concept_id, link_role FROM l WHERE NOT (strategy_id % 10 = 0 AND CAST(concept_id AS BIGINT) = strategy_id AND link_role = 'TARGETS')")
def _(t):
    return linked(t)[0]


@query("knw13_unresolved", STRICT + "SELECT p_partkey AS strategy_id, phrase_norm AS phrase FROM ph JOIN done USING (phrase_norm) WHERE outcome <> 'RESOLVED'")
def _(t):
    return linked(t)[1]


@query("ret17_case_knowledge", PAGE + "SELECT query_id, id, score, rank, 'RELEVANCE_ONLY' AS ranking_basis, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS knowledge FROM page JOIN documents ON CAST(doc_id AS VARCHAR) = id")
def _(t):
    page = retrieval.retrieve(core.text_hits(lambda name: t(name, "*")), 20, 1)
    library_rows = t("documents", "doc_id AS id", "lang", "source")
    return curation.case_knowledge(page, {"DOCUMENT": library_rows}).select("query_id", "id", "score", "rank", "ranking_basis", "knowledge")


@query(
    "ret18_curated_trace",
    "SELECT c_custkey AS curated_id, c_name AS name, coalesce(l.said, '') AS concept_links, coalesce(f.said, '') AS fields FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderpriority, '|' ORDER BY o_orderkey) AS said FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) l ON l.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, '|' ORDER BY o_orderkey) AS said FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) f ON f.o_custkey = c_custkey",
)
def _(t):
    links = t("orders", "o_custkey AS curated_id", "o_orderkey AS source_start", "o_orderpriority AS phrase", "o_orderstatus").filter("o_orderstatus = 'F'").drop("o_orderstatus")
    fields = t("orders", "o_custkey AS curated_id", "o_orderkey AS source_start", "o_orderstatus AS field_name").filter("field_name <> 'F'")
    out = curation.curated_trace(t("customer", "c_custkey AS curated_id", "c_name AS name"), links, fields)
    told = lambda c, f: F.array_join(F.transform(c, lambda x: F.concat(x["source_start"].cast("string"), F.lit(":"), x[f])), "|")
    return out.select("curated_id", "name", told("concept_links", "phrase").alias("concept_links"), told("fields", "field_name").alias("fields"))


# Documents as curated texts: the first line is a strategy, each line of one word that ends in a stop is a subsection.
MARKED = "'# card' || chr(10) || regexp_replace(text, '(?md)^([a-zA-Z]+[.])$', '## $1')"
DUCK_TEXT = "'# card' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_full_match(x, '[a-zA-Z]+\\.') THEN '## ' || x ELSE x END), chr(10))"
LINES = (
    f"WITH d AS (SELECT doc_id, {DUCK_TEXT} AS t FROM documents WHERE text IS NOT NULL), "
    "l AS (SELECT doc_id, t, i, string_split(t, chr(10))[i] AS line FROM (SELECT doc_id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)), "
    "s AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM l), "
    "h AS (SELECT doc_id, t, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, CAST(length(regexp_extract(line, '^(#{1,6})', 1)) AS INTEGER) AS level, trim(regexp_replace(line, '^#{1,6}\\s+', '')) AS heading, a AS start, least(a + length(line) + 1, length(t)) AS body, coalesce(lead(a) OVER w, length(t)) AS \"end\" FROM s WHERE regexp_matches(line, '^#{1,6}\\s+\\S') WINDOW w AS (PARTITION BY doc_id ORDER BY i)) "
)
BLANK = "' ' || chr(9) || chr(10) || chr(13)"
CARDED = (
    LINES + ", k AS (SELECT *, CASE WHEN level = 1 THEN ord END AS head FROM h), o AS (SELECT *, max(head) OVER (PARTITION BY doc_id ORDER BY ord) AS card FROM k), "
    f"v AS (SELECT doc_id, card, ord, t, heading, start, \"end\", body, substring(t, body + 1, \"end\" - body) AS raw, trim(substring(t, body + 1, \"end\" - body), {BLANK}) AS value, CASE WHEN ord = card THEN 'opening_statement' ELSE 'part' END AS field_name FROM o WHERE card IS NOT NULL), "
    f"f AS (SELECT *, body + length(raw) - length(ltrim(raw, {BLANK})) AS source_start FROM v WHERE value <> '') "
)


def curated_docs(t):
    return t("documents", "doc_id", f"{MARKED} AS text").filter("text is not null")


def curated_blocks(t):
    blocks = library.heading_blocks(curated_docs(t), "doc_id", "text")
    blocks = blocks.withColumn("block_kind", F.when(F.col("level") == 1, "STRATEGY").otherwise("SUBSECTION")).withColumn("field_name", F.lit("part"))
    return library.attach_owners(blocks)


@query("cur01_heading_spans", LINES + "SELECT doc_id, ord, level, heading, start, body, \"end\" FROM h")
def _(t):
    return library.heading_blocks(curated_docs(t), "doc_id", "text")


@query("cur03_owners", CARDED + "SELECT doc_id, ord, CASE WHEN level = 1 THEN NULL ELSE card END AS owner_ord FROM o")
def _(t):
    return curated_blocks(t).select("doc_id", "ord", "owner_ord")


@query("cur04_fields", CARDED + "SELECT doc_id, card, ord, field_name, sha256(value) AS value_sha256, source_start, source_start + length(value) AS source_end FROM f")
def _(t):
    return curation.cards(curated_docs(t), curated_blocks(t))[1].withColumn("value_sha256", F.sha2("value", 256)).drop("value")


@query(
    "cur04_cards",
    CARDED + "SELECT doc_id, card, max(CASE WHEN ord = card THEN heading END) AS name, max(CASE WHEN ord = card THEN start END) AS source_start, max(\"end\") AS source_end, sha256(max(CASE WHEN ord = card THEN heading END) || chr(10) || coalesce(string_agg(field_name || '=' || value, chr(10) ORDER BY ord) FILTER (WHERE value <> ''), '')) AS content_hash, CAST(count(*) FILTER (WHERE value <> '') AS INTEGER) AS n_fields FROM v GROUP BY 1, 2",
)
def _(t):
    return curation.cards(curated_docs(t), curated_blocks(t))[0].drop("kind")


@query("cur05_broken_spans", CARDED + "SELECT doc_id, card, ord FROM f WHERE source_start % 7 = 0 AND substring(t, source_start + 2, length(value)) <> value")
def _(t):
    fields = curation.cards(curated_docs(t), curated_blocks(t))[1].withColumn("start", F.col("source_start") + F.when(F.col("source_start") % 7 == 0, 1).otherwise(0)).withColumn("end", F.col("start") + F.length("value"))
    return library.verify_spans(fields, curated_docs(t)).select("doc_id", "card", "ord")


UNITS = CARDED + ", u AS (SELECT doc_id, card, ord, unnest(regexp_extract_all(value, '[a-z]+ing? [a-z]+')) AS phrase FROM f) "
RULES = [("NAMED", "PHRASE", r"(?P<unit>[a-z]+ing? [a-z]+)", None)]


@query("cur06_units", UNITS + "SELECT doc_id, phrase, count(*) AS n, 0 AS broken FROM u GROUP BY 1, 2")
def _(t):
    docs, blocks = curated_docs(t), curated_blocks(t)
    found = curation.units(curation.cards(docs, blocks)[1], RULES).join(docs, "doc_id")
    wrong = F.substring("text", F.col("source_start") + 1, F.col("source_end") - F.col("source_start")) != F.col("phrase")
    return found.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).cast("int").alias("broken"))


SHAPE = "CASE WHEN trim(p) = '' THEN 'empty' WHEN ends_with(trim(p), ':') THEN 'ends in a colon' " + " ".join(f"WHEN contains(p, '{m}') THEN 'contains {m}'" for m in curation.SENTENCE_MARKS) + " WHEN len({0}) = 0 THEN 'stop words only' END"


@query("cur07_name_shapes", "WITH x AS (SELECT conv_id, turn, split_part(text, ' ', 1) || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ':' WHEN 2 THEN ' x' ELSE '' END AS p FROM conversations UNION ALL SELECT conv_id, turn, 'of the' FROM conversations) SELECT conv_id, turn, p AS phrase, " + SHAPE.format(core.LEX.format("p")) + " AS reason FROM x")
def _(t):
    rows = t("conversations", "conv_id", "turn", "split_part(text, ' ', 1) || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN ':' WHEN 2 THEN ' x' ELSE '' END AS phrase").unionByName(t("conversations", "conv_id", "turn", "'of the' AS phrase"))
    return curation.name_shape(rows).select("conv_id", "turn", "phrase", "reason")


@query(
    "cur08_unit_resolution",
    resolver.RESOLVED.format(clash="UNRESOLVED", near="UNRESOLVED") + ", r1 AS (SELECT phrase_norm, CASE WHEN outcome = 'RESOLVED' THEN CAST(split_part(concept_ids, ',', 1) AS BIGINT) END AS concept_id, tier, confidence FROM done) SELECT p_partkey, r1.concept_id, canonical_key, tier, confidence FROM ph JOIN r1 USING (phrase_norm) LEFT JOIN concepts ON concepts.concept_id = r1.concept_id",
)
def _(t):
    done = resolve.resolve(resolver.phrases(t), resolver.tiers(t), resolver.relations(t), read_only=True)
    done = done.withColumn("concept_ids", F.when(F.col("outcome") == "RESOLVED", F.col("concept_ids"))).withColumn("tier", F.col("tier").cast("int")).withColumn("confidence", F.round("confidence", 6))
    return curation.resolve_units(resolver.parts(t).select("p_partkey", "phrase"), done, resolver.concepts(t)).select("p_partkey", "concept_id", "canonical_key", "tier", "confidence")


RECONCILED = (
    "WITH cards AS (SELECT doc_id, doc_id % 3 = 0 AS authoritative, left(text, 5) AS a FROM documents), prior AS (SELECT doc_id, 1 AS concept_id, CASE WHEN doc_id % 5 = 1 THEN '?' || left(text, 4) ELSE left(text, 5) END AS phrase FROM documents WHERE doc_id % 4 <> 0), "
    "n AS (SELECT doc_id, 2 AS concept_id, left(text, 3) AS phrase FROM documents WHERE doc_id % 7 <> 0), "
    "s AS (SELECT cards.doc_id, CASE WHEN authoritative THEN 'RECOMPUTED' WHEN prior.doc_id IS NULL THEN 'FIRST_ATTACHMENT' WHEN prior.phrase <> a THEN 'FAILED_CLOSED' ELSE 'NOT_RECOMPUTED' END AS status, (prior.doc_id IS NOT NULL)::BIGINT AS p, (n.doc_id IS NOT NULL)::BIGINT AS f FROM cards LEFT JOIN prior USING (doc_id) LEFT JOIN n USING (doc_id)) "
)


def reconciled(t):
    docs = t("documents", "doc_id", "text").filter("text is not null")
    cards = docs.selectExpr("doc_id AS curated_id", "doc_id", "doc_id % 3 = 0 AS authoritative")
    prior = docs.filter("doc_id % 4 <> 0").selectExpr("doc_id AS curated_id", "1 AS concept_id", "CASE WHEN doc_id % 5 = 1 THEN '?' || left(text, 4) ELSE left(text, 5) END AS phrase", "0 AS source_start", "5 AS source_end")
    new = docs.selectExpr("doc_id AS curated_id", "CASE WHEN doc_id % 7 <> 0 THEN 2 END AS concept_id", "left(text, 3) AS phrase", "0 AS source_start", "3 AS source_end")
    return curation.reconcile_links(cards, prior, new, docs)


@query("cur09_states", RECONCILED + "SELECT doc_id AS curated_id, status, CASE WHEN status IN ('RECOMPUTED', 'FIRST_ATTACHMENT') THEN f ELSE 0 END AS written, CASE WHEN status = 'NOT_RECOMPUTED' THEN p ELSE 0 END AS retained, CASE WHEN status = 'NOT_RECOMPUTED' THEN 0 ELSE p END AS removed FROM s")
def _(t):
    return reconciled(t)[0]


@query("cur09_links", RECONCILED + "SELECT doc_id AS curated_id, concept_id, phrase FROM n JOIN s USING (doc_id) WHERE status IN ('RECOMPUTED', 'FIRST_ATTACHMENT') UNION ALL SELECT doc_id, concept_id, phrase FROM prior JOIN s USING (doc_id) WHERE status = 'NOT_RECOMPUTED'")
def _(t):
    return reconciled(t)[1].select("curated_id", "concept_id", "phrase")


CONTRACT = {
    "required": ["name", "size", "note"],
    "properties": {"name": {"type": "string", "minLength": 10}, "size": {"type": "integer"}, "kind": {"enum": ["ECONOMY", "SMALL"]}, "version": {"const": "1"}, "note": {"type": ["string", "null"]}},
    "additionalProperties": False,
}


@query(
    "ops13_contract_violations",
    "SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN p_partkey % 6 = 0 THEN 'note: required property missing' END, CASE WHEN length(p_name) < 10 THEN 'name: shorter than 10 characters' END, CASE WHEN p_size % 3 = 0 THEN 'size: expected type integer' END, "
    "CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN 'kind: not one of ECONOMY, SMALL' END, CASE WHEN p_partkey % 5 <> 1 THEN 'version: must be \"1\"' END, CASE WHEN p_partkey % 4 = 0 THEN 'extra: not permitted by the contract' END], lambda x: x IS NOT NULL)), '|') AS violations FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT p_partkey, '(root): expected type object' FROM part WHERE p_partkey % 9 = 0",
)
def _(t):
    body = (
        "'{\"name\":\"' || p_name || '\",\"size\":' || CASE WHEN p_size % 3 = 0 THEN '\"' || p_size || '\"' ELSE cast(p_size AS string) END || ',\"kind\":\"' || p_type || '\",\"version\":\"' || p_partkey % 5 || '\"'"
        " || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE ',\"note\":null' END || CASE WHEN p_partkey % 4 = 0 THEN ',\"extra\":1' ELSE '' END || '}'"
    )
    rows = t("part", "p_partkey", f"CASE WHEN p_partkey % 9 = 0 THEN '[1]' ELSE {body} END AS control")
    return curation.contract_violations(rows, CONTRACT).select("p_partkey", F.array_join("violations", "|").alias("violations"))


@query(
    "knw10_collisions",
    ONTOLOGY + ", st AS (SELECT concept_id, canonical_key, canonical_name FROM concepts WHERE concept_id % 2 = 0), nm AS (SELECT DISTINCT phrase_norm, upper(replace(phrase_norm, ' ', '_')) AS k FROM ph), "
    f"near AS (SELECT phrase_norm, concept_id, round({SIM.format('g', 'h')}, 6) AS sim, row_number() OVER (PARTITION BY phrase_norm ORDER BY {SIM.format('g', 'h')} DESC, concept_id) AS rn FROM (SELECT phrase_norm, {GRAMS.format('phrase_norm')} AS h FROM nm WHERE k NOT IN (SELECT canonical_key FROM st)), (SELECT concept_id, {GRAMS.format('canonical_name')} AS g FROM st) WHERE {SIM.format('g', 'h')} >= 0.92), "
    "hit AS (SELECT phrase_norm, concept_id, 1.0 AS sim FROM nm JOIN st ON k = canonical_key UNION ALL SELECT phrase_norm, concept_id, sim FROM near WHERE rn = 1) SELECT p_partkey AS name_id, concept_id AS strategy_id, CAST(sim AS DOUBLE) AS sim FROM ph JOIN hit USING (phrase_norm)",
)
def _(t):
    names = resolver.parts(t).select(F.col("p_partkey").alias("name_id"), F.col("phrase_norm").alias("name"), X.key_for(F.col("phrase_norm")).alias("strategy_key"))
    s = resolver.concepts(t).filter("concept_id % 2 = 0").select(F.col("concept_id").alias("strategy_id"), F.col("canonical_key").alias("strategy_key"), F.col("canonical_name").alias("name"), F.lit("APPROVED").alias("knowledge_status"))
    return foundation.collisions(names, s).withColumn("sim", F.round("sim", 6))
