"""The library's foundation: evidence, gaps, controversies, ontology queues and generated evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import norm_phrase
from tessera.operators.resolve import gram_pairs, live

# Evaluation layers; sizes of families, probes, cases and queries; similarities; coverage; caps; confidences; needed fields.
LAYERS = {
    "A": "tests made from the concepts that each domain was seeded with",
    "B": "what held-out sources say is to be found again",
    "C": "made-up cases whose concepts lie in several domains",
}
MIN_FAMILY, PROBES, CASE_CONCEPTS, CLAIM_CHARS = 8, 3, 6, 900
COLLISION, IMPACT = 0.92, 0.5
COVERED, MATERIAL, ESCALATED = 6, 60, 5
CONFIDENCES = ("STRONG", "MODERATE", "LIMITED", "MECHANISTIC_ONLY", "CONFLICTING", "INSUFFICIENT", "UNKNOWN")
NEGATIVE = ("claim_or_strategy", "why_investigated", "evidence_examined", "finding", "revisit_trigger")


def _ordered(df: DataFrame, key: list[str], order: list[str], *cols: str):
    """Each key's rows as one sorted array; keys are domains or items, whose rows are few."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *cols))).alias("_m"))


def generate_a(concept_domains: DataFrame, concepts: DataFrame, domains: DataFrame) -> DataFrame:
    """Per domain of MIN_FAMILY live concepts: the first ones by key are named in the query, the rest expected."""
    rows = concept_domains.join(live(concepts), "concept_id")
    m = _ordered(rows, ["domain_id"], ["canonical_key"], "concept_id", "name").filter(F.size("_m") >= MIN_FAMILY)
    m = m.join(domains.select("domain_id", F.col("name").alias("domain_name")), "domain_id")
    probes = F.transform(F.slice("_m", 1, PROBES), lambda x: x["name"])
    expected = F.transform(F.slice("_m", F.lit(PROBES + 1), F.size("_m")), lambda x: x["concept_id"])
    return m.select("domain_id", F.lit("A").alias("layer"), F.concat("domain_name", F.lit(": "), F.array_join(probes, ", ")).alias("query_text"), expected.alias("expected"))


def generate_b(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Per held-out item: its concepts in order of first mention; the query is its title and the claims' beginning."""
    m = _ordered(keys, ["item_id"], ["extracted_at", "key_id"], "claim_text", "concept_ids").join(items.filter("held_out"), "item_id")
    expected = F.array_distinct(F.flatten(F.transform("_m", lambda x: F.coalesce(x["concept_ids"], F.array().cast("array<string>")))))
    claims = F.left(F.array_join(F.transform("_m", lambda x: x["claim_text"]), " "), F.lit(CLAIM_CHARS))
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("held-out source"))
    return m.select("item_id", F.lit("B").alias("layer"), F.concat(title, F.lit(": "), claims).alias("query_text"), expected.alias("expected")).filter(F.size("expected") > 0)


def generate_c(coverage: DataFrame, concept_domains: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per domain with COVERED covered dimensions: a case of its first concepts by key."""
    deep = coverage.groupBy("domain_id").agg(F.count_if("covered").alias("n")).filter(F.col("n") >= COVERED)
    m = _ordered(concept_domains.join(deep, "domain_id", "left_semi").join(live(concepts), "concept_id"), ["domain_id"], ["canonical_key"], "concept_id")
    return m.select("domain_id", F.lit("C").alias("layer"), F.transform(F.slice("_m", 1, CASE_CONCEPTS), lambda x: x["concept_id"]).alias("query_concepts"))


def evaluation_state(runs: DataFrame, tests: DataFrame) -> DataFrame:
    """All layers, each with its active tests and its last finished run."""
    cols = ["run_id", "started_at", "tests_run", "tests_passed", "mean_score"]
    last = runs.filter("finished_at is not null").groupBy("layer").agg(F.max_by(F.struct(*cols), F.struct("started_at", "run_id")).alias("_r"))
    n = tests.filter("active").groupBy("layer").agg(F.count(F.lit(1)).alias("tests_defined"))
    rows = runs.sparkSession.createDataFrame(list(LAYERS.items()), "layer string, description string")
    out = rows.join(last, "layer", "left").join(n, "layer", "left").fillna(0, ["tests_defined"])
    return out.select("layer", "description", "tests_defined", *[F.col(f"_r.{c}") for c in cols])


def escalation_queue(proposals: DataFrame, concepts: DataFrame) -> DataFrame:
    near = concepts.select(F.col("concept_id").alias("candidate_concept"), F.col("canonical_key").alias("nearest_concept"))
    rows = proposals.filter("decision = 'ESCALATED'").join(near, "candidate_concept", "left")
    return rows.orderBy(F.desc("impact_score"), "created_at")


def needs_type_queue(proposals: DataFrame) -> DataFrame:
    return proposals.filter("decision = 'NEEDS_TYPE' and resolved_at is null").orderBy(F.desc("impact_score"), "created_at")


def impact(phrases: DataFrame, strategy_concepts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(phrase, impact): strategy links of concepts whose name is more than IMPACT similar; 0 without any."""
    links = strategy_concepts.groupBy("concept_id").agg(F.count(F.lit(1)).alias("_n"))
    a = phrases.select("phrase").distinct()
    pairs = gram_pairs(a.select(F.col("phrase").alias("phrase_id"), F.col("phrase").alias("name")), concepts.select("concept_id", "name"), "phrase_id", "concept_id", IMPACT)
    n = pairs.filter(F.col("sim") > IMPACT).join(links, "concept_id").groupBy(F.col("phrase_id").alias("phrase")).agg(F.sum("_n").alias("impact"))
    return a.join(n, "phrase", "left").fillna(0, ["impact"])


def learn_aliases(resolved: DataFrame, accept: float) -> DataFrame:
    """An alias for each phrase that was resolved by trigrams; confirmed at a tier's threshold and above."""
    rows = resolved.filter("status = 'RESOLVED' and method = 'TRIGRAM'")
    return rows.select(norm_phrase(F.col("phrase")).alias("alias"), F.try_element_at("selected", F.lit(1)).alias("concept_id"), (F.col("confidence") >= accept).alias("confirmed")).distinct()


def extract_pending(envelopes: DataFrame, kinds: DataFrame) -> DataFrame:
    """Normalised envelopes for the model extractor, oldest first; kinds is a bounded registry."""
    routed = F.broadcast(kinds.filter("extractor = 'MODEL'").select("kind"))
    return envelopes.filter("status = 'NORMALIZED' and extractable and duplicate_of is null").join(routed, "kind", "left_semi").orderBy("received_at", "envelope_id")


def apply_assessment(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """Claims with their findings; an empty finding says so, an unknown confidence is UNKNOWN."""
    f = findings.select("claim_id", F.coalesce(F.nullif(F.btrim("finding"), F.lit("")), F.lit("No finding was stated.")).alias("finding"), F.upper(F.btrim("confidence")).alias("_c"))
    known = F.when(F.col("_c").isin(*CONFIDENCES), F.col("_c")).otherwise("UNKNOWN")
    return claims.join(f, "claim_id").withColumn("confidence", known).drop("_c")


def collisions(names: DataFrame, strategies: DataFrame) -> DataFrame:
    """(name_id, strategy_id, sim): the strategy of the same key, else the most similar name from COLLISION on."""
    s = strategies.filter("knowledge_status <> 'DEPRECATED'").select("strategy_id", "strategy_key", "name")
    exact = names.join(s.select("strategy_id", "strategy_key"), "strategy_key").groupBy("name_id").agg(F.min("strategy_id").alias("strategy_id")).withColumn("sim", F.lit(1.0))
    rest = names.join(exact, "name_id", "left_anti").select("name_id", "name")
    near = gram_pairs(rest, s.select("strategy_id", "name"), "name_id", "strategy_id", COLLISION)
    best = near.groupBy("name_id").agg(F.max_by(F.struct("strategy_id", "sim"), F.struct("sim", -F.col("strategy_id"))).alias("_b"))
    return exact.unionByName(best.select("name_id", "_b.strategy_id", "_b.sim"))


def retrieval_gaps(strategies: DataFrame, links: DataFrame, gaps: DataFrame) -> DataFrame:
    """An open gap for each strategy that no concept leads to and that has none open."""
    held = gaps.filter("kind = 'RETRIEVAL' and status = 'OPEN'").select("strategy_id")
    rows = strategies.join(links.select("strategy_id"), "strategy_id", "left_anti").join(held, "strategy_id", "left_anti")
    return rows.select("strategy_id", F.lit("RETRIEVAL").alias("kind"), F.lit("HIGH").alias("severity"), F.lit("OPEN").alias("status"))


def escalate_gaps(gaps: DataFrame, order: list, cap: int = ESCALATED) -> DataFrame:
    """gaps with the first cap open ones, by order and id, under research."""
    taken = gaps.filter("status = 'OPEN'").orderBy(*order, "gap_id").limit(cap).select("gap_id", F.lit("RESEARCHING").alias("_s"))
    return gaps.join(F.broadcast(taken), "gap_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def domain_material(concept_domains: DataFrame, links: DataFrame, cap: int = MATERIAL) -> DataFrame:
    """(domain_id, item_id, rank): distinct items that a domain's concepts lead to, the first cap of each domain."""
    rows = concept_domains.select("domain_id", "concept_id").join(links.select("concept_id", "item_id"), "concept_id").select("domain_id", "item_id").distinct()
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("domain_id").orderBy("item_id"))).filter(F.col("rank") <= cap)


def land_controversies(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(controversies, positions): records with a question and at least two positions that aren't blank."""
    held = F.filter(F.coalesce("positions", F.array().cast("array<string>")), lambda x: F.btrim(x) != "")
    rows = records.withColumn("positions", held).filter((F.coalesce(F.btrim("question"), F.lit("")) != "") & (F.size("positions") >= 2))
    return rows.drop("positions"), rows.select("controversy_id", F.posexplode("positions").alias("position_no", "position"))


def land_negative(records: DataFrame) -> DataFrame:
    """Findings of which all required fields are filled."""
    for name in NEGATIVE:
        records = records.filter(F.coalesce(F.btrim(name), F.lit("")) != "")
    return records


def controversy_state(domains: DataFrame, passes: DataFrame, controversies: DataFrame, positions: DataFrame, negative: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per active domain: whether a pass was made, what it found, and whether one is overdue."""
    p = positions.groupBy("controversy_id").agg(F.count(F.lit(1)).alias("_p"))
    c = controversies.join(p, "controversy_id", "left").groupBy("domain_id").agg(F.count(F.lit(1)).alias("controversies"), F.sum("_p").alias("positions"))
    n = negative.groupBy("domain_id").agg(F.count(F.lit(1)).alias("negative_findings"))
    v = coverage.groupBy("domain_id").agg(F.count_if("covered").alias("_v"))
    out = domains.filter("active").join(passes.select("domain_id", "assessed_at"), "domain_id", "left")
    for part in (c, n, v):
        out = out.join(part, "domain_id", "left")
    out = out.fillna(0, ["controversies", "positions", "negative_findings", "_v"]).withColumn("pass_performed", F.col("assessed_at").isNotNull())
    return out.withColumn("overdue", ~F.col("pass_performed") & (F.col("_v") >= COVERED)).drop("_v")


def gap_assess_queue(readiness: DataFrame) -> DataFrame:
    return readiness.filter("not gap_assessment_complete and dimensions_covered > 0").orderBy(F.desc("dimensions_covered"), "domain_key")


def evidence_without_claim(evidence: DataFrame, linked_from: str) -> DataFrame:
    """Evidence without a claim, and whether it is older than the link."""
    old = F.col("created_at") < F.lit(linked_from).cast("timestamp")
    return evidence.filter("claim_id is null").withColumn("why", F.when(old, "PREDATES_LINK").otherwise("INVESTIGATE"))


def evidence_for(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    return evidence.join(claims.select("claim_id").distinct(), "claim_id", "left_semi").orderBy("claim_id", "created_at", "evidence_id")


def asr_claims(claims: DataFrame, envelopes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Claims from envelopes of which the transcript was made by a machine."""
    auto = transcripts.filter("auto_generated").select("transcript_id").distinct()
    return claims.join(envelopes.join(auto, "transcript_id", "left_semi").select("envelope_id").distinct(), "envelope_id", "left_semi")


def wave1_readiness(readiness: DataFrame, strategies: DataFrame, links: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: domains, depth, tests and provenance as counts, and whether every floor is met."""
    r = readiness.agg(F.count_if("is_core").alias("core_domains"), F.count(F.lit(1)).alias("all_domains"), F.count_if(F.col("is_core") & F.col("foundation_ready")).alias("core_ready"))
    s = strategies.filter("knowledge_status <> 'DEPRECATED'").join(links.select("strategy_id", F.lit(True).alias("_l")).distinct(), "strategy_id", "left")
    bare = (F.col("knowledge_status") != "AI_DISCOVERED_CANDIDATE") & F.col("provenance_note").isNull()
    s = s.agg(F.count(F.lit(1)).alias("strategies"), F.count_if(bare).alias("unprovenanced"), F.count_if(F.col("_l").isNull()).alias("unretrievable"))
    t = tests.agg(F.count_if("active").alias("tests_defined"))
    out = r.crossJoin(s).crossJoin(t)  # one row each
    met = "core_domains > 0 and core_ready = core_domains and strategies > 0 and tests_defined > 0 and unprovenanced = 0 and unretrievable = 0"
    return out.withColumn("foundation_ready", F.expr(met))


def foundation_queue(domains: DataFrame, progress: DataFrame) -> DataFrame:
    """Active domains in the order in which they are worked on."""
    out = domains.filter("active").join(progress, "domain_id", "left").fillna({"stage": "DISCOVER", "passes": 0, "paused": False})
    return out.orderBy("paused", F.desc("is_core"), F.desc("priority"), F.asc_nulls_first("last_advanced"), "domain_key")


def handoff_registry(handoffs: DataFrame) -> DataFrame:
    """Required and optional tags of each engine and mode."""
    tags = lambda want: F.array_sort(F.collect_list(F.when(F.col("required") == want, F.col("tag"))))
    return handoffs.filter("active").groupBy("engine", "mode").agg(tags(True).alias("required_tags"), tags(False).alias("optional_tags"), F.count(F.lit(1)).alias("registered_tags"))


def missing_handoffs(runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs of runs that succeeded without a tag or with nothing in it."""
    return runs.filter("status = 'SUCCEEDED'").join(outputs.filter("handoff_tag is null or structured = '{}'"), "run_id")


def unlinked_fields(fields: DataFrame, links: DataFrame) -> DataFrame:
    """Fields that no linked unit lies in, with their length."""
    return fields.join(links.select("field_id"), "field_id", "left_anti").withColumn("n_chars", F.length("text"))


def curated_bodies(cards: DataFrame, fields: DataFrame) -> DataFrame:
    """Each card's name and the texts of its fields in order of their place."""
    body = _ordered(fields.filter("text is not null"), ["card_id"], ["source_start"], "text")
    joined = F.array_join(F.transform("_m", lambda x: x["text"]), " ")
    return cards.join(body, "card_id", "left").select("card_id", F.concat_ws(" ", "name", joined).alias("body"))
