"""The ontology and the resolver on names of parts, each query with the SQL that gives the same rows.

A concept is a type and a name of parts, a phrase is what a part is called: its concept's name, the two
halves swapped, the plural, or something unknown.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import curation, foundation, resolve
from tessera.plans.core import GRAMS, KEY, SIM
from tessera.plans.states import collector

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = collector(QUERIES, ORACLE)

PHRASE = "CASE p_size % 4 WHEN 0 THEN lower(p_type) || ' ' || p_name WHEN 1 THEN p_name || ' ' || lower(p_type) WHEN 2 THEN lower(p_type) || ' ' || p_name || 's' ELSE replace(lower(p_brand), '#', ' ') || ' thing' END"
STATUS = "CASE concept_id % 7 WHEN 0 THEN 'PROPOSED' WHEN 1 THEN 'SEEDED' ELSE 'ACTIVE' END"
ONTOLOGY = (
    "WITH c0 AS (SELECT min(p_partkey) AS concept_id, p_type AS concept_type, p_name FROM part GROUP BY p_type, p_name), "
    "concepts AS (SELECT *, lower(concept_type) || ' ' || p_name AS canonical_name, upper(replace(lower(concept_type) || ' ' || p_name, ' ', '_')) AS canonical_key, "
    f"{STATUS} AS status, split_part(p_name, ' ', 2) AS noun FROM c0), "
    "live AS (SELECT * FROM concepts WHERE status <> 'PROPOSED'), "
    "aliases AS (SELECT concept_id, p_name || ' ' || lower(concept_type) AS alias_norm, concept_id % 3 = 0 AS confirmed FROM concepts), "
    f"ph AS (SELECT p_partkey, {PHRASE} AS phrase_norm FROM part), phrases AS (SELECT DISTINCT phrase_norm FROM ph), "
    "rel AS (SELECT a.concept_id AS x, b.concept_id AS y FROM concepts a JOIN concepts b ON a.concept_type = b.concept_type AND a.noun = b.noun AND a.concept_id < b.concept_id), "
    "t1a AS (SELECT phrase_norm, l.concept_id FROM phrases JOIN aliases a ON alias_norm = phrase_norm AND confirmed JOIN live l ON l.concept_id = a.concept_id), "
    "t1 AS (SELECT * FROM t1a UNION SELECT phrase_norm, concept_id FROM phrases JOIN live ON canonical_name = phrase_norm WHERE phrase_norm NOT IN (SELECT phrase_norm FROM t1a)), "
    "dict AS (SELECT noun AS token, min(canonical_key) AS canonical_key FROM concepts WHERE noun < 'n' GROUP BY 1), "
    "t2k AS (SELECT phrase_norm, min_by(canonical_key, token) AS canonical_key FROM phrases JOIN dict ON contains(' ' || phrase_norm || ' ', ' ' || token || ' ') GROUP BY 1), "
    "t2 AS (SELECT phrase_norm, concept_id FROM t2k JOIN live USING (canonical_key)), "
    "names AS (SELECT concept_id, canonical_name AS name FROM live UNION ALL SELECT a.concept_id, alias_norm FROM aliases a JOIN live USING (concept_id) WHERE confirmed), "
    f"ng AS (SELECT concept_id, {GRAMS.format('name')} AS g FROM names), pg AS (SELECT phrase_norm, {GRAMS.format('phrase_norm')} AS h FROM phrases), "
    f"s AS (SELECT phrase_norm, concept_id, max({SIM.format('g', 'h')}) AS confidence FROM ng, pg WHERE {SIM.format('g', 'h')} >= 0.72 GROUP BY 1, 2), "
    "t3 AS (SELECT *, confidence >= max(confidence) OVER (PARTITION BY phrase_norm) - 0.01 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY phrase_norm ORDER BY confidence DESC, concept_id) AS rn FROM s) WHERE rn <= 5), "
    "cand AS (SELECT phrase_norm, 1 AS tier, concept_id, 1.0::DOUBLE AS confidence, true AS selected, 1.0::DOUBLE AS accept FROM t1 UNION ALL SELECT phrase_norm, 2, concept_id, 0.99, true, 0.99 FROM t2 UNION ALL SELECT phrase_norm, 3, concept_id, confidence, selected, 0.92 FROM t3), "
    "clash AS (SELECT a.phrase_norm, a.tier, string_agg(DISTINCT CAST(x AS VARCHAR) || '|' || CAST(y AS VARCHAR), ',' ORDER BY CAST(x AS VARCHAR) || '|' || CAST(y AS VARCHAR)) AS clashes FROM cand a JOIN rel ON a.concept_id = x JOIN cand b ON b.concept_id = y AND a.phrase_norm = b.phrase_norm AND a.tier = b.tier GROUP BY 1, 2) "
)
RESOLVED = (
    ONTOLOGY + ", r AS (SELECT phrase_norm, tier, accept, max(confidence) FILTER (WHERE selected) AS confidence, string_agg(CAST(concept_id AS VARCHAR), ',' ORDER BY concept_id) FILTER (WHERE selected) AS concept_ids FROM cand GROUP BY 1, 2, 3), "
    "e AS (SELECT r.*, CASE WHEN clashes IS NOT NULL THEN '{clash}' WHEN confidence >= accept THEN 'RESOLVED' ELSE 'NEAR' END AS event FROM r LEFT JOIN clash USING (phrase_norm, tier)), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY phrase_norm ORDER BY event = 'NEAR', CASE WHEN event = 'NEAR' THEN -confidence ELSE tier END, tier) AS rn FROM e), "
    "done AS (SELECT p.phrase_norm, CASE WHEN event IS NULL THEN 'UNRESOLVED' WHEN event = 'NEAR' THEN '{near}' ELSE event END AS outcome, CAST(tier AS INTEGER) AS tier, concept_ids, round(confidence, 6) AS confidence FROM phrases p LEFT JOIN f ON p.phrase_norm = f.phrase_norm AND rn = 1) "
)
STRICT = RESOLVED.format(clash="ESCALATED", near="NEAR_MISS")


def concepts(t):
    c = t("part", "p_partkey", "p_type AS concept_type", "p_name").groupBy("concept_type", "p_name").agg(F.min("p_partkey").alias("concept_id"))
    c = c.selectExpr("*", "lower(concept_type) || ' ' || p_name AS canonical_name", "split_part(p_name, ' ', 2) AS noun", f"{STATUS} AS status")
    return c.withColumn("canonical_key", F.upper(F.replace("canonical_name", F.lit(" "), F.lit("_"))))


def aliases(t):
    return concepts(t).selectExpr("concept_id AS alias_id", "concept_id", "p_name || ' ' || lower(concept_type) AS alias_text", "p_name || ' ' || lower(concept_type) AS alias_norm", "'SEED' AS method", "concept_id % 3 = 0 AS confirmed")


def parts(t):
    return t("part", "p_partkey", f"{PHRASE} AS phrase").select("p_partkey", "phrase", X.norm_phrase(F.col("phrase")).alias("phrase_norm"))


def phrases(t):
    return parts(t).select("phrase_norm").distinct()


def relations(t):
    c = concepts(t).select("concept_id", "concept_type", "noun")
    other = c.withColumnRenamed("concept_id", "to_concept")
    rows = c.join(other, ["concept_type", "noun"]).filter("concept_id < to_concept")
    return rows.select(F.col("concept_id").alias("from_concept"), "to_concept", F.lit("CONFUSABLE_DO_NOT_MERGE").alias("relation_type"))


def dictionary(t):
    return concepts(t).filter("noun < 'n'").groupBy(F.col("noun").alias("token")).agg(F.min("canonical_key").alias("key")).withColumn("pos", F.col("token"))


def structured(t):
    """The dictionary says a key; its column beside the concepts' own."""
    return resolve.tier_structured(phrases(t), dictionary(t), concepts(t))


def tiers(t):
    return [resolve.tier_alias(phrases(t), aliases(t), concepts(t)), structured(t), resolve.tier_trigram(phrases(t), concepts(t), aliases(t))]


def told(rows):
    ids = F.array_join(F.col("concept_ids").cast("array<string>"), ",")
    return rows.withColumn("concept_ids", ids).withColumn("confidence", F.round("confidence", 6)).withColumn("tier", F.col("tier").cast("int"))


@query("nrm05_similarity", f"SELECT p_partkey, round({SIM.format(GRAMS.format('p_name'), GRAMS.format('p_type || p_name'))}, 6) AS sim FROM part")
def _(t):
    return t("part", "p_partkey", "p_name", "p_type || p_name AS other").select("p_partkey", F.round(X.trgm_similarity(X.trigrams(F.col("p_name")), X.trigrams(F.col("other"))), 6).alias("sim"))


@query("nrm06_alias_tier", ONTOLOGY + "SELECT phrase_norm, concept_id FROM t1")
def _(t):
    return tiers(t)[0].select("phrase_norm", "concept_id")


@query("nrm07_structured_tier", ONTOLOGY + "SELECT phrase_norm, concept_id FROM t2")
def _(t):
    return structured(t).select("phrase_norm", "concept_id")


@query("nrm08_trigram_tier", ONTOLOGY + "SELECT phrase_norm, concept_id, round(confidence, 6) AS confidence, selected FROM t3")
def _(t):
    return tiers(t)[2].select("phrase_norm", "concept_id", F.round("confidence", 6).alias("confidence"), "selected")


@query(
    "nrm09_semantic_tier",
    "WITH s AS (SELECT q.vec_id AS phrase_norm, v.vec_id AS concept_id, round(greatest(0.0, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))), 6) AS confidence FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.label % 5 <> 0), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY phrase_norm ORDER BY confidence DESC, concept_id) AS rn FROM s) SELECT phrase_norm, concept_id, confidence, rn = 1 AS selected FROM k WHERE rn <= 3 AND phrase_norm IN (SELECT phrase_norm FROM k WHERE rn = 1 AND confidence >= 0.78)",
)
def _(t):
    v = t("embeddings", "vec_id AS concept_id", "cast(label AS string) AS concept_type", "CASE WHEN label % 5 = 0 THEN 'MERGED' ELSE 'ACTIVE' END AS status", "embedding")
    q = t("embeddings", "vec_id AS phrase_norm", "embedding").filter("phrase_norm % 50 = 0")
    return resolve.tier_semantic(q, v).select("phrase_norm", "concept_id", "confidence", "selected")


@query("nrm10_confusable_guard", ONTOLOGY + "SELECT phrase_norm, CAST(tier AS INTEGER) AS tier, clashes FROM clash")
def _(t):
    every = tiers(t)
    found = resolve.confusable_clash(every[0].unionByName(every[1]).unionByName(every[2]), relations(t))
    return found.select("phrase_norm", "tier", F.array_join("clashes", ",").alias("clashes"))


@query("nrm11_type_guard", ONTOLOGY + "SELECT DISTINCT phrase_norm, 3 AS tier FROM t3 JOIN concepts USING (concept_id) WHERE selected AND concept_type NOT IN ('ECONOMY', 'SMALL')")
def _(t):
    return resolve.type_reject(tiers(t)[2], ["ECONOMY", "SMALL"])


@query("nrm12_cascade", STRICT + "SELECT * FROM done")
def _(t):
    return told(resolve.resolve(phrases(t), tiers(t), relations(t)))


@query("nrm18_read_only", RESOLVED.format(clash="UNRESOLVED", near="UNRESOLVED") + "SELECT * FROM done")
def _(t):
    return told(resolve.resolve(phrases(t), tiers(t), relations(t), read_only=True))


@query("nrm19_batch", STRICT + "SELECT p_partkey, outcome, tier, concept_ids, confidence FROM ph JOIN done USING (phrase_norm)")
def _(t):
    done = told(resolve.resolve(phrases(t), tiers(t), relations(t)))
    return parts(t).select("p_partkey", "phrase_norm").join(done, "phrase_norm").drop("phrase_norm")


@query(
    "nrm13_impact",
    ONTOLOGY + f", n AS (SELECT concept_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN concepts ON p_type = concept_type AND part.p_name = concepts.p_name GROUP BY 1), cg AS (SELECT concept_id, {GRAMS.format('canonical_name')} AS g FROM concepts), "
    f"i AS (SELECT phrase_norm, CAST(sum(n) AS BIGINT) AS impact FROM pg, cg JOIN n USING (concept_id) WHERE {SIM.format('g', 'h')} > 0.5 GROUP BY 1) SELECT phrase_norm AS phrase, coalesce(impact, 0) AS impact FROM phrases LEFT JOIN i USING (phrase_norm)",
)
def _(t):
    c = concepts(t)
    links = t("lineitem", "l_partkey AS p_partkey").join(t("part", "p_partkey", "p_type AS concept_type", "p_name"), "p_partkey").join(c.select("concept_id", "concept_type", "p_name"), ["concept_type", "p_name"]).select("concept_id")
    return foundation.impact(phrases(t).select(F.col("phrase_norm").alias("phrase")), links, c.select("concept_id", F.col("canonical_name").alias("name")))


@query(
    "nrm14_escalation",
    "WITH near AS (SELECT event_id AS phrase_norm, CAST(floor(value / 20) AS BIGINT) AS impact, ts AS arrived_at FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-29'), used AS (SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 45 AND ts > TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-22 06:00:00'), "
    "k AS (SELECT phrase_norm, row_number() OVER (ORDER BY arrived_at, phrase_norm) AS rn FROM near WHERE impact > 0) SELECT phrase_norm, CASE WHEN rn <= 15 - (SELECT n FROM used) THEN 'ESCALATED' ELSE 'LOGGED' END AS decision FROM near LEFT JOIN k USING (phrase_norm)",
)
def _(t):
    near = t("events", "event_id AS phrase_norm", "floor(value / 20) AS impact", "ts AS arrived_at", "event_type").filter("event_type = 'error' and arrived_at >= '2024-01-29'").drop("event_type")
    past = t("events", "ts AS created_at", "value", "CASE WHEN event_type = 'purchase' AND value > 45 THEN 'ESCALATED' ELSE 'LOGGED' END AS decision").filter("created_at < '2024-01-22 06:00:00'")
    return resolve.decide_near(near, past, F.lit("2024-01-29").cast("timestamp")).select("phrase_norm", "decision")


KEYED = f"coalesce(CASE WHEN regexp_full_match({KEY.format('phrase')}, '[A-Z][A-Z0-9_]{{2,79}}') THEN {KEY.format('phrase')} END, 'PHRASE_' || upper(substring(sha256(phrase), 1, 12)))"


@query(
    "nrm15_terminal_proposals",
    f"WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN (SELECT min(p_name) FROM part) || '!' WHEN c_custkey % 4 = 1 THEN '漢' || c_custkey ELSE c_name END AS phrase, c_custkey % 3 AS k FROM customer), x AS (SELECT *, CASE WHEN k = 2 THEN 'NEEDS_TYPE' ELSE 'AUTO_CREATE' END AS kind, CASE k WHEN 1 THEN 'FOOD' WHEN 0 THEN 'PHYSIOLOGY' END AS concept_type, {KEYED} AS key FROM u), "
    "have AS (SELECT upper(replace(p_name, ' ', '_')) AS key, CASE WHEN p_name < 'h' THEN p_name ELSE p_name || ' x' END AS have FROM (SELECT DISTINCT p_name FROM part)), "
    "y AS (SELECT x.*, have, trim(regexp_replace(regexp_replace(lower(phrase), '[^a-z0-9%+/\\- ]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM x LEFT JOIN have USING (key)) "
    "SELECT c_custkey, kind, concept_type, CASE WHEN kind = 'NEEDS_TYPE' THEN 'NONE' WHEN have = norm THEN 'REUSE' ELSE 'CREATE' END AS action, CASE WHEN have IS NOT NULL AND have <> norm THEN left(key, 73) || '_' || upper(substring(sha256(phrase), 1, 6)) ELSE key END AS canonical_key FROM y",
)
def _(t):
    least = t("part", "p_name").agg(F.min("p_name").alias("least"))
    u = t("customer", "c_custkey", "c_name").crossJoin(F.broadcast(least)).selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN least || '!' WHEN c_custkey % 4 = 1 THEN '漢' || c_custkey ELSE c_name END AS phrase",
        "CASE c_custkey % 3 WHEN 1 THEN array('FOOD') WHEN 2 THEN array('FOOD', 'DRUG') END AS allowed_types",
    )
    c = t("part", "upper(replace(p_name, ' ', '_')) AS canonical_key", "CASE WHEN p_name < 'h' THEN p_name ELSE p_name || ' x' END AS canonical_name").distinct()
    return resolve.terminal_proposals(u, c).select("c_custkey", "kind", "concept_type", "action", "canonical_key")


@query("nrm16_learned_aliases", STRICT + "SELECT DISTINCT phrase_norm AS alias, CAST(split_part(concept_ids, ',', 1) AS BIGINT) AS concept_id, confidence >= 0.95 AS confirmed FROM done WHERE outcome = 'RESOLVED' AND tier = 3")
def _(t):
    done = resolve.resolve(phrases(t), tiers(t), relations(t))
    rows = done.select(F.col("phrase_norm").alias("phrase"), F.col("outcome").alias("status"), F.when(F.col("tier") == 3, "TRIGRAM").alias("method"), F.col("concept_ids").alias("selected"), "confidence")
    return foundation.learn_aliases(rows, 0.95)


@query(
    "nrm17_cache_probe",
    ONTOLOGY + ", cache AS (SELECT phrase_norm, min(p_partkey) AS k FROM ph GROUP BY 1), two AS (SELECT phrase_norm, a.concept_id AS x, b.concept_id AS y FROM cache JOIN concepts a ON a.concept_id % 64 = k % 64 JOIN concepts b ON b.concept_id % 64 = k % 64 AND a.concept_id < b.concept_id) SELECT phrase_norm, CAST(k % 3 AS BIGINT) AS ontology_revision FROM cache WHERE k % 3 = 1 AND phrase_norm NOT IN (SELECT phrase_norm FROM two JOIN rel USING (x, y))",
)
def _(t):
    cache = parts(t).groupBy("phrase_norm").agg(F.min("p_partkey").alias("k"))
    ids = concepts(t).groupBy((F.col("concept_id") % 64).alias("slot")).agg(F.array_sort(F.collect_list("concept_id")).alias("candidate_ids"))
    cache = cache.withColumn("slot", F.col("k") % 64).join(ids, "slot", "left").select("phrase_norm", (F.col("k") % 3).alias("ontology_revision"), F.coalesce("candidate_ids", F.expr("cast(array() AS array<bigint>)")).alias("candidate_ids"))
    return resolve.probe_cache(phrases(t), cache, 1, relations(t)).select("phrase_norm", "ontology_revision")


@query("ont01_split_aliases", "SELECT p_partkey, p_name AS name, array_to_string(list_filter([p_type, p_brand], lambda a: lower(a) <> lower(p_name)), '|') AS aliases FROM (SELECT * FROM part) WHERE p_type <> p_brand")
def _(t):
    rows = t("part", "p_partkey", "p_name || ' (' || p_type || ') / ' || p_brand || ' / ' || upper(p_name) AS term").withColumn("s", resolve.split_aliases(F.col("term")))
    return rows.select("p_partkey", "s.name", F.array_join("s.aliases", "|").alias("aliases"))


@query(
    "ont02_seed_merge",
    ONTOLOGY + "SELECT canonical_key, canonical_name AS name, domains, CASE WHEN concept_id % 2 = 0 THEN 'REUSE' ELSE 'INSERT' END AS action FROM concepts JOIN (SELECT p_type, p_name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS domains FROM part GROUP BY 1, 2) d ON concept_type = p_type AND concepts.p_name = d.p_name",
)
def _(t):
    terms = t("part", "p_brand AS domain", "lower(p_type) || ' ' || p_name AS term")
    return resolve.seed_ontology(terms, concepts(t).filter("concept_id % 2 = 0")).select("canonical_key", "name", F.array_join("domains", ",").alias("domains"), "action")


@query(
    "ont03_alias_collisions",
    ONTOLOGY + ", a AS (SELECT c.concept_id, d.canonical_name AS alias_norm FROM concepts c JOIN (SELECT p_name, min(canonical_name) AS canonical_name FROM concepts GROUP BY 1) d USING (p_name)), bad AS (SELECT a.concept_id AS x, c.concept_id AS y FROM a JOIN concepts c ON c.canonical_name = alias_norm WHERE a.concept_id <> c.concept_id) SELECT DISTINCT * FROM (SELECT x AS from_concept, y AS to_concept FROM bad UNION ALL SELECT y, x FROM bad)",
)
def _(t):
    c = concepts(t)
    least = c.groupBy("p_name").agg(F.min("canonical_name").alias("alias_norm"))
    a = c.join(least, "p_name").select(F.col("concept_id").alias("alias_id"), "concept_id", F.lit("SEED").alias("method"), "alias_norm")
    return resolve.alias_collisions(a, c)[1].select("from_concept", "to_concept")


@query("ont05_mirrored", ONTOLOGY + "SELECT x AS from_concept, y AS to_concept FROM rel UNION SELECT y, x FROM rel")
def _(t):
    return resolve.mirror(relations(t)).select("from_concept", "to_concept")


@query(
    "ont06_concept_domains",
    "SELECT DISTINCT p_partkey AS concept_id, n_nationkey AS domain_id FROM part JOIN nation ON chr(CAST(65 + n_nationkey AS INTEGER)) IN (chr(CAST(65 + p_size % 26 AS INTEGER)), chr(CAST(65 + p_partkey % 26 AS INTEGER)))",
)
def _(t):
    c = t("part", "p_partkey AS concept_id", "'seen in DOMAIN ' || chr(65 + p_size % 26) || ', DOMAIN ' || chr(65 + p_partkey % 26) || ' and DOMAIN XY' AS origin_detail")
    return resolve.concept_domains(c, t("nation", "chr(65 + n_nationkey) AS domain_code", "n_nationkey AS domain_id"))


@query("ont07_active_concepts", ONTOLOGY + ", p AS (SELECT concept_type, min(concept_id) AS parent FROM concepts GROUP BY 1) SELECT live.concept_id, live.canonical_key, q.canonical_key AS parent_key FROM live JOIN p USING (concept_type) LEFT JOIN concepts q ON q.concept_id = p.parent")
def _(t):
    c = concepts(t)
    c = c.join(c.groupBy("concept_type").agg(F.min("concept_id").alias("parent_concept_id")), "concept_type")
    return resolve.active_concepts(c).select("concept_id", "canonical_key", "parent_key")


@query("ont08_confusable_pairs", ONTOLOGY + "SELECT a.canonical_key AS key_a, b.canonical_key AS key_b FROM rel JOIN live a ON x = a.concept_id JOIN live b ON y = b.concept_id")
def _(t):
    return curation.confusable_pairs(resolve.mirror(relations(t)), concepts(t)).select("key_a", "key_b")


@query(
    "ont11_normalisation_tests",
    ONTOLOGY + ", pairs AS (SELECT canonical_name AS a, alias_norm AS b, true AS same, 'ALIAS_PAIR' AS src FROM live JOIN aliases USING (concept_id) WHERE confirmed AND alias_norm <> canonical_name UNION ALL SELECT * FROM (SELECT canonical_name, lead(canonical_name) OVER (PARTITION BY concept_type ORDER BY concept_id) AS nxt, false, 'SIBLING_PAIR' FROM live) WHERE nxt IS NOT NULL UNION ALL SELECT a.canonical_name, b.canonical_name, false, 'CONFUSABLE_PAIR' FROM rel JOIN live a ON x = a.concept_id JOIN live b ON y = b.concept_id), "
    "known AS (SELECT canonical_name AS p, concept_id FROM live WHERE concept_id % 5 <> 0 UNION SELECT alias_norm, concept_id FROM aliases WHERE concept_id % 2 = 0) "
    "SELECT src AS generated_from, same AS expect_same, count(*) AS tests, count(*) FILTER (WHERE coalesce(x.concept_id = y.concept_id, false) = same) AS passed FROM pairs LEFT JOIN known x ON x.p = a LEFT JOIN known y ON y.p = b GROUP BY 1, 2",
)
def _(t):
    c = resolve.live(concepts(t)).withColumnRenamed("concept_type", "parent_concept_id")
    tests = curation.normalisation_pairs(c, aliases(t).filter("confirmed"), relations(t))
    known = c.filter("concept_id % 5 <> 0").select(F.col("canonical_name").alias("phrase"), "concept_id").unionByName(aliases(t).filter("concept_id % 2 = 0").select(F.col("alias_norm").alias("phrase"), "concept_id"))
    known = known.groupBy("phrase").agg(F.collect_set("concept_id").alias("concept_ids"))
    return curation.score_pairs(tests, known).groupBy("generated_from", "expect_same").agg(F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("passed"))


@query(
    "ont12_revision_diff",
    ONTOLOGY + "SELECT concept_id, CASE WHEN concept_id % 5 = 0 THEN 'DELETED' WHEN concept_id % 5 = 1 THEN 'INSERTED' ELSE 'CHANGED' END AS change FROM live WHERE concept_id % 5 IN (0, 1, 2)",
)
def _(t):
    c = concepts(t).withColumn("merged_into", F.lit(None).cast("string"))
    new = c.filter("concept_id % 5 <> 0").withColumn("canonical_name", F.expr("CASE WHEN concept_id % 5 = 2 THEN canonical_name || ' x' ELSE canonical_name END"))
    return resolve.ontology_changed(c.filter("concept_id % 5 <> 1"), new)


@query(
    "ont13_threshold_sweep",
    "WITH th AS (SELECT n_nationkey, 0.5 + n_nationkey / 50.0 AS threshold FROM nation), n AS (SELECT doc_id, (doc_id % 100) / 100.0 AS score, CASE WHEN quality = 1 THEN 'RIGHT' WHEN quality = 0 THEN 'WRONG' WHEN doc_id % 2 = 0 THEN 'PARTIAL' ELSE 'BROADER' END AS v FROM documents LEFT JOIN labels USING (doc_id)) "
    "SELECT n_nationkey, count(v) AS admitted, count(*) FILTER (WHERE v = 'RIGHT') AS \"right\", count(*) FILTER (WHERE v = 'PARTIAL') AS partial, count(*) FILTER (WHERE v = 'BROADER') AS broader, count(*) FILTER (WHERE v = 'WRONG') AS wrong FROM th LEFT JOIN n ON CAST(score AS DOUBLE) >= CAST(threshold AS DOUBLE) GROUP BY 1",
)
def _(t):
    th = t("nation", "n_nationkey", "cast(0.5 + n_nationkey / 50.0D AS double) AS threshold")
    n = t("documents", "doc_id", "(doc_id % 100) / 100.0D AS score").join(t("labels", "doc_id", "quality"), "doc_id", "left")
    n = n.selectExpr("doc_id AS phrase", "score", "CASE WHEN quality = 1 THEN 'RIGHT' WHEN quality = 0 THEN 'WRONG' WHEN doc_id % 2 = 0 THEN 'PARTIAL' ELSE 'BROADER' END AS verdict")
    out = resolve.sweep(n, th.select("threshold").distinct()).join(th, "threshold")
    return out.select("n_nationkey", "admitted", "right", "partial", "broader", "wrong")


@query(
    "ont14_verdicts",
    "WITH o AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS got, CASE l_orderkey % 3 WHEN 0 THEN 'RESOLVE' WHEN 1 THEN 'PARTIAL' ELSE 'NO_MATCH' END AS expected, l_orderkey % 11 = 0 AS nothing FROM lineitem GROUP BY 1), g AS (SELECT *, CASE WHEN nothing THEN [] ELSE got END AS g FROM o) "
    "SELECT l_orderkey, CASE WHEN list_has_any(g, ['R']) AND l_orderkey % 2 = 0 THEN 'WRONG' WHEN len(g) = 0 AND expected = 'NO_MATCH' THEN 'REFUSED' WHEN len(g) = 0 THEN 'MISSED' WHEN list_has_any(g, ['R']) THEN 'WRONG' WHEN list_contains(g, 'A') AND expected = 'RESOLVE' THEN 'RIGHT' WHEN list_contains(g, 'A') THEN CASE WHEN expected = 'PARTIAL' THEN 'PARTIAL' ELSE 'PARTIAL_MISS' END ELSE 'BROADER' END AS verdict FROM g",
)
def _(t):
    g = t("lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("got"))
    none = "cast(array() AS array<string>)"
    rows = g.selectExpr(
        "l_orderkey", f"CASE WHEN l_orderkey % 11 = 0 THEN {none} ELSE got END AS got", "CASE l_orderkey % 3 WHEN 0 THEN 'RESOLVE' WHEN 1 THEN 'PARTIAL' ELSE 'NO_MATCH' END AS expected",
        "array('A') AS to", f"CASE WHEN l_orderkey % 2 = 0 THEN array('R') ELSE {none} END AS must_not", "array('N') AS tolerable",
    )
    return resolve.verdicts(rows).select("l_orderkey", "verdict")
