"""Evidence, decisions and concept links; curated cards with their spans; traces, case knowledge, contracts, test pairs."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import key_for, norm_phrase
from tessera.operators.foundation import CONFIDENCES
from tessera.operators.resolve import live
from tessera.operators.retrieval import STOP_WORDS, lexemes

# Designs of studies, relationships of evidence, decisions, roles of a link, marks of a sentence.
STUDY_DESIGNS = (
    "SYSTEMATIC_REVIEW", "META_ANALYSIS", "RCT", "CONTROLLED_TRIAL", "CROSSOVER", "PROSPECTIVE_COHORT", "RETROSPECTIVE_COHORT", "CASE_CONTROL",
    "CROSS_SECTIONAL", "CASE_SERIES", "MECHANISTIC", "ANIMAL", "IN_VITRO", "GUIDELINE", "CONSENSUS", "OTHER",
)
RELATIONSHIPS = ("SUPPORTS", "PARTIALLY_SUPPORTS", "LIMITS", "CONFLICTS", "NEUTRAL", "CONTEXTUALIZES")
DECISIONS = ("CREATE", "UPDATE", "MERGE", "NO_CHANGE")
LINK_ROLES = ("TARGETS", "INDICATED_FOR", "POPULATION", "MECHANISM", "CONTRAINDICATED", "REQUIRES_CONTEXT")
SENTENCE_MARKS = (".", "?", "!", ",", '"', "“", "”", "→")
OPENING_FIELD, CARD_NAME_FIELD = "opening_statement", "strategy_name"
#: Characters of a citation that is a new item's title.
TITLE = 500


def known_or(c: Column, values: tuple[str, ...], other: str) -> Column:
    word = F.upper(F.btrim(c))
    return F.when(word.isin(*values), word).otherwise(other)


def land_evidence(raw: DataFrame, items: DataFrame, claim_col: str = "claim_id", json_col: str = "records") -> DataFrame:
    """A row for each record with a citation; its study is a known item of the same doi, pmid or url, a new one, or none.

    Unknown designs are OTHER, unknown relationships NEUTRAL; years and sizes that aren't whole numbers are null.
    """
    rows = raw.select(claim_col, F.posexplode(F.from_json(json_col, "array<string>")).alias("pos", "_r")).withColumn("_v", F.try_parse_json("_r"))

    def text(name):
        return F.nullif(F.btrim(F.get_json_object("_r", f"$.{name}")), F.lit(""))

    def whole(name):
        kind = F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))
        return F.when(kind == "BIGINT", F.try_variant_get("_v", f"$.{name}", "bigint"))

    rows = rows.select(
        claim_col, "pos", text("citation").alias("citation"), known_or(text("design"), STUDY_DESIGNS, "OTHER").alias("design"),
        known_or(text("relationship"), RELATIONSHIPS, "NEUTRAL").alias("relationship"), whole("publication_year").alias("publication_year"),
        whole("sample_size").alias("sample_size"), text("doi").alias("doi"), text("pmid").alias("pmid"), text("url").alias("url"),
    ).filter("citation is not null")
    found = []
    for name, key in (("doi", F.lower("doi")), ("pmid", F.col("pmid")), ("url", F.col("url"))):
        have = items.filter(f"{name} is not null").groupBy(key.alias(f"_{name}")).agg(F.min("item_id").alias(f"_by_{name}"))
        rows = rows.withColumn(f"_{name}", key).join(have, f"_{name}", "left").drop(f"_{name}")
        found.append(F.col(f"_by_{name}"))
    named = F.coalesce("doi", "pmid", "url").isNotNull()
    item = F.coalesce(*found)
    rows = rows.withColumn("item_id", item).withColumn("study", F.when(item.isNotNull(), "KNOWN").when(named, "NEW").otherwise("NONE"))
    return rows.drop(*[f"_by_{n}" for n in ("doi", "pmid", "url")])


def apply_decisions(decisions: DataFrame, strategies: DataFrame, collides: DataFrame, fields: list[str], order: str = "decision_id") -> tuple[DataFrame, DataFrame]:
    """(strategies after, outcomes by decision_id).

    decisions: decision_id, decision, strategy_id, name, evidence_confidence and fields; collides (decision_id,
    strategy_id) says which names the library has. A CREATE that collides is an UPDATE of what it collides with; of two
    of one key the first creates. Only fields that aren't null overwrite; of several updates the last that says
    one counts. An UPDATE of an unknown strategy, a CREATE without a name and an unknown decision are REFUSED. MERGE
    leaves the fields alone (its links are merge_links()).
    """
    d = decisions.withColumn("decision", F.upper(F.btrim("decision"))).withColumn("name", F.nullif(F.btrim("name"), F.lit(""))).withColumn("_key", key_for(F.col("name")))
    d = d.join(collides.select("decision_id", F.col("strategy_id").alias("_hit")), "decision_id", "left")
    makes = (F.col("decision") == "CREATE") & F.col("name").isNotNull() & F.col("_hit").isNull()
    first = d.filter(makes).groupBy("_key").agg(F.min_by("decision_id", order).alias("_first"))
    d = d.join(first, "_key", "left")
    own = F.concat(F.lit("new-"), F.col("_first").cast("string"))
    create = makes & (F.col("decision_id") == F.col("_first"))
    target = F.when(F.col("decision") == "CREATE", F.coalesce(F.col("_hit"), F.when(makes, own))).when(F.col("decision") == "UPDATE", F.col("strategy_id"))
    d = d.withColumn("_target", target)
    have = strategies.select(F.col("strategy_id").alias("_target"), F.lit(True).alias("_have"))
    d = d.join(have, "_target", "left")
    outcome = (
        F.when(create, "CREATE").when((F.col("decision") == "CREATE") & F.col("name").isNotNull(), "UPDATE").when((F.col("decision") == "UPDATE") & F.col("_have"), "UPDATE")
        .when(F.col("decision").isin("MERGE", "NO_CHANGE"), F.col("decision")).otherwise("REFUSED")
    )
    d = d.withColumn("outcome", outcome)
    said = d.filter("outcome in ('CREATE', 'UPDATE')").groupBy(F.col("_target").alias("strategy_id")).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_{f}") for f in fields],
        F.max(F.when(F.col("outcome") == "CREATE", F.col("name"))).alias("_name"),
        F.max(F.when(F.col("outcome") == "CREATE", known_or(F.col("evidence_confidence"), CONFIDENCES, "UNKNOWN"))).alias("_confidence"),
    )
    out = strategies.withColumn("_old", F.lit(True)).join(said, "strategy_id", "full")
    cols = {f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}
    cols |= {"name": F.coalesce("name", "_name"), "evidence_confidence": F.coalesce("evidence_confidence", "_confidence")}
    cols["knowledge_status"] = F.coalesce("knowledge_status", F.lit("AI_DISCOVERED_CANDIDATE"))
    after = out.withColumns(cols).drop("_old", "_name", "_confidence", *[f"_{f}" for f in fields])
    return after, d.select("decision_id", F.col("_target").alias("strategy_id"), "outcome")


def link_concepts(phrases: DataFrame, resolutions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links to add, phrases without a concept). phrases: strategy_id, phrase, role; resolutions: phrase_norm, concept_ids.

    A role outside the six is TARGETS; a link that is there isn't added again.
    """
    rows = phrases.withColumn("phrase", F.btrim("phrase")).filter("phrase <> ''")
    rows = rows.withColumn("link_role", known_or(F.col("role"), LINK_ROLES, "TARGETS")).withColumn("phrase_norm", norm_phrase(F.col("phrase")))
    rows = rows.join(resolutions.select("phrase_norm", "concept_ids"), "phrase_norm", "left").withColumn("concept_ids", F.when(F.size("concept_ids") > 0, F.col("concept_ids")))
    made = rows.select("strategy_id", F.explode("concept_ids").alias("concept_id"), "link_role").distinct()
    keys = ["strategy_id", "concept_id", "link_role"]
    return made.join(links.select(*keys), keys, "left_anti"), rows.filter("concept_ids is null").select("strategy_id", "phrase").distinct()


def cards(docs: DataFrame, blocks: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(cards, fields) of the STRATEGY and PRINCIPLE headings: the text below one is its opening statement, owned subsections its other fields.

    blocks: doc_id, ord, heading, level, start, body, end, block_kind, owner_ord, field_name. The span of a field is
    tight, so the text at its span is its value; empty fields are left out. A card ends where the last it owns does;
    its hash is of its name and fields.
    """
    b = blocks.withColumn("card", F.when(F.col("block_kind").isin("STRATEGY", "PRINCIPLE"), F.col("ord")).otherwise(F.col("owner_ord"))).filter("card is not null")
    b = b.withColumn("field_name", F.when(F.col("ord") == F.col("card"), OPENING_FIELD).otherwise(F.col("field_name")))
    raw = F.substring(F.col(text_col), F.col("body") + 1, F.col("end") - F.col("body"))
    blank = F.lit(" \n\t\r")
    b = b.join(docs.select("doc_id", text_col), "doc_id").withColumn("_raw", raw)
    b = b.withColumn("source_start", F.col("body") + F.length("_raw") - F.length(F.ltrim("_raw", blank))).withColumn("value", F.btrim("_raw", blank))
    b = b.withColumn("source_end", F.col("source_start") + F.length("value"))
    fields = b.filter("value <> ''").select("doc_id", "card", "ord", "field_name", "value", "source_start", "source_end")
    own = F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("ord", F.concat("field_name", F.lit("="), "value").alias("said")))))
    at = F.col("ord") == F.col("card")
    grouped = b.groupBy("doc_id", "card").agg(
        F.max(F.when(at, F.col("heading"))).alias("name"), F.max(F.when(at, F.col("block_kind"))).alias("kind"), F.max(F.when(at, F.col("start"))).alias("source_start"),
        F.max("end").alias("source_end"), own.alias("_own"),
    )
    body = F.array_join(F.transform("_own", lambda x: x["said"]), "\n")
    return grouped.withColumn("content_hash", F.sha2(F.concat("name", F.lit("\n"), body), 256)).withColumn("n_fields", F.size("_own")).drop("_own"), fields


def units(fields: DataFrame, rules: list[tuple[str, str, str, tuple[str, ...] | None]], keys: tuple[str, ...] = ("doc_id", "card")) -> DataFrame:
    """(keys, rule_id, unit_kind, field_name, phrase, source_start, source_end): what rules find in fields (field_name, value, source_start).

    A rule is (rule_id, unit_kind, pattern with a group unit, the fields it applies to or None for all). Spans are
    offsets in the original, tightened onto the phrase. Column functions have no offsets of matches, so this is an
    Arrow function of batches.
    """
    compiled = [(i, k, re.compile(p, re.M), a) for i, k, p, a in rules]
    names = [*keys, "rule_id", "unit_kind", "field_name", "phrase", "source_start", "source_end"]
    kinds = [f for f in fields.select(*keys).schema.fields]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kinds), "rule_id string, unit_kind string, field_name string, phrase string, source_start long, source_end long"])

    def run(batches):
        for batch in batches:
            out, who = [], []
            values = zip(*(batch.column(c).to_pylist() for c in ("field_name", "value", "source_start")), strict=True)
            for row, (field, value, offset) in enumerate(values):
                for rule_id, kind, pattern, applies in compiled:
                    for m in pattern.finditer(value or "") if not applies or field in applies else ():
                        phrase = m["unit"].strip()
                        if phrase:
                            start = offset + m.start("unit") + len(m["unit"]) - len(m["unit"].lstrip())
                            out.append((rule_id, kind, field, phrase, start, start + len(phrase)))
                            who.append(row)
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.string()] * 4 + [pa.int64()] * 2
            own = [batch.column(k).take(pa.array(who, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return fields.select(*keys, "field_name", "value", F.col("source_start").cast("long")).mapInArrow(run, schema)


def name_shape(found: DataFrame, phrase_col: str = "phrase", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """found with reason: why a phrase is no name, or null if it is one."""
    s = F.btrim(F.col(phrase_col))
    why = F.when(F.coalesce(s, F.lit("")) == "", "empty").when(s.endswith(":"), "ends in a colon")
    for mark in SENTENCE_MARKS:
        why = why.when(s.contains(mark), F.lit(f"contains {mark}"))
    return found.withColumn("reason", why.when(F.size(lexemes(s, stop_words)) == 0, "stop words only"))


def resolve_units(found: DataFrame, resolutions: DataFrame, concepts: DataFrame) -> DataFrame:
    """found with the first concept of a read-only resolution (phrase_norm, concept_ids, tier, confidence) and its key, or nulls."""
    rows = found.withColumn("phrase_norm", norm_phrase(F.col("phrase"))).join(resolutions.select("phrase_norm", "concept_ids", "tier", "confidence"), "phrase_norm", "left")
    rows = rows.withColumn("concept_id", F.try_element_at("concept_ids", F.lit(1))).drop("concept_ids", "phrase_norm")
    return rows.join(concepts.select("concept_id", "canonical_key"), "concept_id", "left")


def reconcile_links(cards: DataFrame, prior: DataFrame, new: DataFrame, docs: DataFrame, card: str = "curated_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(state of each card, links after). cards: card, doc_id, authoritative; prior and new: card, concept_id, phrase, source_start, source_end.

    An authoritative run replaces a card's links; a run without authority writes them where there are none, keeps
    those there are, and deletes them if one no longer stands at its span. New links without a concept are left out.
    """
    fresh = new.filter("concept_id is not null").dropDuplicates([card, "concept_id", "source_start", "source_end"])
    at = prior.join(cards.select(card, "doc_id"), card).join(docs.select("doc_id", text_col), "doc_id", "left")
    moved = ~F.col("phrase").eqNullSafe(F.substring(F.col(text_col), F.col("source_start") + 1, F.col("source_end") - F.col("source_start")))
    had = at.groupBy(card).agg(F.count(F.lit(1)).alias("_prior"), F.count_if(moved).alias("_stale"))
    n = fresh.groupBy(card).agg(F.count(F.lit(1)).alias("_new"))
    state = cards.join(had, card, "left").join(n, card, "left").fillna(0, ["_prior", "_stale", "_new"])
    status = F.when(F.col("authoritative"), "RECOMPUTED").when(F.col("_prior") == 0, "FIRST_ATTACHMENT").when(F.col("_stale") > 0, "FAILED_CLOSED").otherwise("NOT_RECOMPUTED")
    state = state.withColumn("status", status)
    writes, keeps = F.col("status").isin("RECOMPUTED", "FIRST_ATTACHMENT"), F.col("status") == "NOT_RECOMPUTED"
    state = state.select(
        card, "status", F.when(writes, F.col("_new")).otherwise(0).alias("written"), F.when(keeps, F.col("_prior")).otherwise(0).alias("retained"), F.when(keeps, 0).otherwise(F.col("_prior")).alias("removed")
    )
    columns = [card, "concept_id", "phrase", "source_start", "source_end"]
    after = fresh.join(state.filter(writes), card, "left_semi").select(*columns).unionByName(prior.join(state.filter(keeps), card, "left_semi").select(*columns))
    return state, after


def curated_trace(cards: DataFrame, links: DataFrame, fields: DataFrame, card: str = "curated_id") -> DataFrame:
    """cards with their concept links and fields, each in the order of its span."""

    def nested(rows, name):
        cols = [c for c in rows.columns if c not in (card, "source_start")]
        return rows.groupBy(card).agg(F.array_sort(F.collect_list(F.struct("source_start", *cols))).alias(name))

    out = cards.join(nested(links, "concept_links"), card, "left").join(nested(fields, "fields"), card, "left")
    for name, rows in (("concept_links", links), ("fields", fields)):
        out = out.withColumn(name, F.coalesce(name, F.expr(f"cast(array() AS {out.schema[name].dataType.simpleString()})")))
    return out


def case_knowledge(page: DataFrame, library: dict[str, DataFrame]) -> DataFrame:
    """page with what the library says of each row, as JSON; the order is relevance, not priority. library: kind -> (id, columns of the kind)."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*[c for c in df.columns if c != "id"])).alias("knowledge")) for kind, df in library.items()]
    rows = page.filter(F.col("kind").isin(*library)).join(reduce(DataFrame.unionByName, parts), ["kind", "id"], "left")
    return rows.withColumn("score", F.round("score", 6)).withColumn("ranking_basis", F.lit("RELEVANCE_ONLY"))


#: The JSON Schema type of each variant type.
VARIANT_TYPES = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number"}


def contract_violations(rows: DataFrame, contract: dict, json_col: str = "control") -> DataFrame:
    """rows with violations: sorted texts, one wording for each rule of the contract that a JSON object breaks.

    contract is a JSON Schema of properties with required, type, enum, const, minLength and additionalProperties.
    A text that isn't a JSON object breaks the type of the root.
    """

    def plain(value) -> str:
        return value if isinstance(value, str) else json.dumps(value)

    v = F.try_parse_json(json_col)
    keys = F.coalesce(F.json_object_keys(json_col), F.expr("cast(array() AS array<string>)"))
    broken = [F.when(~F.array_contains(keys, name), f"{name}: required property missing") for name in contract.get("required", [])]
    for name, rule in contract.get("properties", {}).items():
        there, text = F.array_contains(keys, name), F.get_json_object(json_col, f"$.{name}")
        raw = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        kind = F.when(raw.startswith("ARRAY"), "array").when(raw.startswith("OBJECT"), "object").when(raw.startswith("DECIMAL"), "number")
        for variant, json_type in VARIANT_TYPES.items():
            kind = kind.when(raw == variant, json_type)
        kind = F.coalesce(kind, F.lit("null"))
        if types := rule.get("type"):
            allowed = [types] if isinstance(types, str) else list(types)
            fits = kind.isin(*allowed) | (kind == "integer" if "number" in allowed else F.lit(False))
            broken.append(F.when(there & ~fits, f"{name}: expected type {', '.join(sorted(allowed))}"))
        if values := rule.get("enum"):
            broken.append(F.when(there & ~F.coalesce(text.isin(*map(plain, values)), F.lit(False)), f"{name}: not one of {', '.join(sorted(map(str, values)))}"))
        if "const" in rule:
            broken.append(F.when(there & ~F.coalesce(text == plain(rule["const"]), F.lit(False)), f"{name}: must be {json.dumps(rule['const'])}"))
        if least := rule.get("minLength"):
            reason = "must not be empty" if least == 1 else f"shorter than {least} characters"
            broken.append(F.when(there & (kind == "string") & (F.length(text) < least), f"{name}: {reason}"))
    found = F.array(*broken) if broken else F.expr("cast(array() AS array<string>)")
    if contract.get("additionalProperties") is False:
        known = F.array(*map(F.lit, contract.get("properties", {})))
        found = F.concat(found, F.transform(F.array_except(keys, known), lambda k: F.concat(k, F.lit(": not permitted by the contract"))))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = F.when(is_object, F.filter(found, lambda x: x.isNotNull())).otherwise(F.array(F.lit("(root): expected type object")))
    return rows.withColumn("violations", F.array_sort(F.array_distinct(found)))


def confusable_pairs(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Each pair of live concepts that must not be merged, once, with both keys; relations may be mirrored."""
    a = live(concepts).select(F.col("concept_id").alias("from_concept"), F.col("canonical_key").alias("key_a"))
    b = live(concepts).select(F.col("concept_id").alias("to_concept"), F.col("canonical_key").alias("key_b"))
    pairs = relations.filter("relation_type = 'CONFUSABLE_DO_NOT_MERGE'").select(F.least("from_concept", "to_concept").alias("from_concept"), F.greatest("from_concept", "to_concept").alias("to_concept")).distinct()
    return pairs.join(a, "from_concept").join(b, "to_concept")


def normalisation_pairs(concepts: DataFrame, aliases: DataFrame, relations: DataFrame) -> DataFrame:
    """(phrase_a, phrase_b, expect_same, generated_from): aliases of live concepts, neighbouring siblings of a parent, confusable pairs.

    A parent's concepts are paired with the next one only, so a large family gives as many tests as it has members.
    """
    ok = live(concepts)
    alias = ok.join(aliases.select("concept_id", "alias_norm"), "concept_id").filter(norm_phrase(F.col("canonical_name")) != F.col("alias_norm"))
    alias = alias.select(F.col("canonical_name").alias("phrase_a"), F.col("alias_norm").alias("phrase_b"), F.lit(True).alias("expect_same"), F.lit("ALIAS_PAIR").alias("generated_from"))
    following = F.lead("canonical_name").over(W.partitionBy("parent_concept_id").orderBy("concept_id"))
    sibling = ok.filter("parent_concept_id is not null").select(F.col("canonical_name").alias("phrase_a"), following.alias("phrase_b"), F.lit(False).alias("expect_same"), F.lit("SIBLING_PAIR").alias("generated_from")).filter("phrase_b is not null")
    a = ok.select(F.col("concept_id").alias("from_concept"), F.col("canonical_name").alias("phrase_a"))
    b = ok.select(F.col("concept_id").alias("to_concept"), F.col("canonical_name").alias("phrase_b"))
    pairs = relations.filter("relation_type = 'CONFUSABLE_DO_NOT_MERGE' and from_concept < to_concept").join(a, "from_concept").join(b, "to_concept")
    pairs = pairs.select("phrase_a", "phrase_b", F.lit(False).alias("expect_same"), F.lit("CONFUSABLE_PAIR").alias("generated_from"))
    return alias.unionByName(sibling).unionByName(pairs)


def score_pairs(tests: DataFrame, resolutions: DataFrame) -> DataFrame:
    """tests with passed: both phrases have a concept in common just if they should. resolutions: phrase, concept_ids."""
    a = resolutions.select(F.col("phrase").alias("phrase_a"), F.col("concept_ids").alias("_a"))
    b = resolutions.select(F.col("phrase").alias("phrase_b"), F.col("concept_ids").alias("_b"))
    rows = tests.join(a, "phrase_a", "left").join(b, "phrase_b", "left")
    return rows.withColumn("passed", F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False)) == F.col("expect_same")).drop("_a", "_b")
