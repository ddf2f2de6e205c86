"""Ontology upkeep and phrase resolution: alias, dictionary, trigram and vector tiers, guards, cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import disambiguate, key_for, norm_phrase, trgm_similarity, trigrams
from tessera.operators.nearest import nearest

# Thresholds of the tiers and of generated confusables.
TRIGRAM_FLOOR, TRIGRAM_ACCEPT, TIE_BAND, TRIGRAM_TOP = 0.72, 0.92, 0.01, 5
SEMANTIC_FLOOR, SEMANTIC_ACCEPT, SEMANTIC_TOP = 0.78, 0.82, 3
CONFUSABLE_LOW, CONFUSABLE_HIGH = 0.45, 0.85
WEEKLY_CAP = 15
#: Keys of a block: the pairs of two names are dealt out as pairs of such blocks.
BLOCK_KEYS = 256
LIVE = ("SEEDED", "ACTIVE")


def live(concepts: DataFrame) -> DataFrame:
    return concepts.filter(F.col("status").isin(*LIVE))


def _name_pairs(a: DataFrame, b: DataFrame, floor: float, block: list[str], ordered: bool) -> DataFrame:
    """(block, name_a, name_b, sim) of the distinct names of both sides.

    Only the rarest grams of each side are joined: sets of sizes m and n with similarity t share at least
    t * max(m, n) grams, so of the grams in order of rarity the first m - ceil(t * m) + 1 suffice. Only sets of like
    sizes meet, and a pair is kept at its first common gram only, so nothing is deduplicated.
    """

    def grams(df, name):
        return df.select(*block, F.col("name").alias(name)).distinct().withColumn("g", trigrams(F.col(name))).filter("size(g) > 0")

    ga, gb = grams(a, "name_a"), grams(b, "name_b")
    rarity = gb.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def prefixed(df, name, own):
        rows = df.select(name, *block, F.explode("g").alias("gram")).join(rarity, "gram", "left")
        sets = rows.groupBy(name, *block).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("s"))
        keep = F.size("s") - F.ceil(floor * F.size("s")) + 1
        sets = sets.select(name, *block, F.transform("s", lambda x: x["gram"]).alias(own), F.transform(F.slice("s", F.lit(1), keep.cast("int")), lambda x: x["gram"]).alias(f"{own}_p"))
        return sets.select("*", F.explode(f"{own}_p").alias("gram"))

    pairs = prefixed(ga, "name_a", "g").join(prefixed(gb, "name_b", "h"), ["gram", *block])
    pairs = pairs.filter("name_a <= name_b") if ordered else pairs
    pairs = pairs.filter((F.size("g") >= floor * F.size("h")) & (F.size("h") >= floor * F.size("g")))
    pairs = pairs.filter(F.element_at(F.array_intersect("g_p", "h_p"), 1) == F.col("gram"))
    return pairs.select("name_a", "name_b", *block, trgm_similarity(F.col("g"), F.col("h")).alias("sim")).filter(F.col("sim") >= floor)


def gram_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, floor: float, block: list[str] | None = None, ceiling: float = 1.0, ordered: bool = False) -> DataFrame:
    """(a_key, b_key, sim) with trigram similarity from floor to ceiling; a and b have a column name.

    Names are compared once, whatever number of keys they have. block: columns that must be equal as well.
    ordered: both sides are one table, and each pair is given once, with a_key < b_key.
    """
    block = block or []
    names = _name_pairs(a, b, floor, block, ordered).filter(F.col("sim") <= ceiling)
    if ordered:
        return _key_pairs(names, a.select(*block, "name", F.col(a_key).alias("key")), a_key, b_key, block)
    left, right = a.select(a_key, *block, F.col("name").alias("name_a")), b.select(b_key, *block, F.col("name").alias("name_b"))
    return names.join(left, [*block, "name_a"]).join(right, [*block, "name_b"]).select(a_key, b_key, *block, "sim")


def _key_pairs(names: DataFrame, keys: DataFrame, a_key: str, b_key: str, block: list[str]) -> DataFrame:
    """(a_key, b_key, sim), a_key < b_key: the keys of each pair of names.

    The keys of a name are put in blocks of about BLOCK_KEYS, and pairs of blocks are dealt over all partitions before
    they become pairs of keys; joins of single keys would leave all pairs of a name, or of a few names, to one task.
    """
    many = keys.groupBy(*block, "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK_KEYS)
    many = many.select(*block, "name", F.ceil(F.col("n") / BLOCK_KEYS).alias("blocks"))
    dealt = keys.join(many, [*block, "name"], "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1).cast("long"))))
    blocks = dealt.groupBy(*block, "name", "part").agg(F.collect_list("key").alias("keys"))
    left, right = (blocks.select(*block, F.col("name").alias(f"name_{side}"), F.col("keys").alias(f"keys_{side}")) for side in "ab")
    pairs = names.join(left, [*block, "name_a"]).join(right, [*block, "name_b"])
    pairs = pairs.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.withColumn("key_a", F.explode("keys_a")).withColumn("key_b", F.explode("keys_b"))
    pairs = pairs.filter((F.col("key_a") < F.col("key_b")) | (F.col("name_a") != F.col("name_b")))
    return pairs.select(F.least("key_a", "key_b").alias(a_key), F.greatest("key_a", "key_b").alias(b_key), *block, "sim")


def _tier(df: DataFrame, n: int, accept: float) -> DataFrame:
    return df.select("phrase_norm", F.lit(n).alias("tier"), "concept_id", "concept_type", F.col("confidence").cast("double").alias("confidence"), "selected", F.lit(accept).alias("accept"))


def tier_alias(phrases: DataFrame, aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """Confirmed aliases first; only for phrases without one the canonical names."""
    ok = live(concepts).select("concept_id", "concept_type", norm_phrase(F.col("canonical_name")).alias("name_norm"))
    by_alias = phrases.join(aliases.filter("confirmed").select(F.col("alias_norm").alias("phrase_norm"), "concept_id"), "phrase_norm").join(ok.drop("name_norm"), "concept_id")
    rest = phrases.join(by_alias.select("phrase_norm"), "phrase_norm", "left_anti")
    by_name = rest.join(ok.withColumnRenamed("name_norm", "phrase_norm"), "phrase_norm")
    found = by_alias.select("phrase_norm", "concept_id", "concept_type").unionByName(by_name.select("phrase_norm", "concept_id", "concept_type")).distinct()
    return _tier(found.withColumn("confidence", F.lit(1.0)).withColumn("selected", F.lit(True)), 1, 1.0)


def tier_structured(phrases: DataFrame, dictionary: DataFrame, concepts: DataFrame) -> DataFrame:
    """The first token of a small ordered dictionary (pos, token, key) that stands in the phrase."""
    hits = phrases.join(F.broadcast(dictionary), F.expr("contains(concat(' ', phrase_norm, ' '), concat(' ', token, ' '))"))
    first = hits.groupBy("phrase_norm").agg(F.min_by("key", "pos").alias("canonical_key"))
    found = first.join(live(concepts).select("canonical_key", "concept_id", "concept_type"), "canonical_key")
    return _tier(found.withColumn("confidence", F.lit(0.99)).withColumn("selected", F.lit(True)), 2, 0.99)


def tier_trigram(phrases: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """The five most similar concepts by name or confirmed alias; those near the best are selected."""
    ok = live(concepts)
    names = ok.select("concept_id", F.col("canonical_name").alias("name"))
    names = names.unionByName(aliases.filter("confirmed").select("concept_id", F.col("alias_text").alias("name")).join(ok.select("concept_id"), "concept_id", "left_semi"))
    names = names.withColumn("name_id", F.sha2(F.concat_ws("|", "concept_id", "name"), 256))
    sims = gram_pairs(phrases.select("phrase_norm", F.col("phrase_norm").alias("name")), names.select("name_id", "name"), "phrase_norm", "name_id", TRIGRAM_FLOOR)
    best = sims.join(names.select("name_id", "concept_id").distinct(), "name_id").groupBy("phrase_norm", "concept_id").agg(F.max("sim").alias("confidence"))
    w = W.partitionBy("phrase_norm").orderBy(F.desc("confidence"), "concept_id")
    top = best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= TRIGRAM_TOP)
    top = top.withColumn("selected", F.col("confidence") >= F.max("confidence").over(W.partitionBy("phrase_norm")) - TIE_BAND)
    return _tier(top.join(ok.select("concept_id", "concept_type"), "concept_id"), 3, TRIGRAM_ACCEPT)


def top_k(queries: DataFrame, vectors: DataFrame, q_id: str, v_id: str, k: int) -> DataFrame:
    """(q_id, v_id, score, rank): exact nearest by cosine of unit vectors, by matrix products of blocks."""
    return nearest(queries, vectors, q_id, v_id, k)


def tier_semantic(phrase_vectors: DataFrame, concepts: DataFrame) -> DataFrame:
    ok = live(concepts).filter("embedding is not null")
    top = top_k(phrase_vectors, ok, "phrase_norm", "concept_id", SEMANTIC_TOP)
    top = top.withColumn("_best", F.max("score").over(W.partitionBy("phrase_norm"))).filter(F.col("_best") >= SEMANTIC_FLOOR).drop("_best")
    found = top.join(ok.select("concept_id", "concept_type"), "concept_id").withColumn("confidence", F.col("score")).withColumn("selected", F.col("rank") == 1)
    return _tier(found, 4, SEMANTIC_ACCEPT)


def mirror(relations: DataFrame) -> DataFrame:
    back = relations.filter("relation_type = 'CONFUSABLE_DO_NOT_MERGE'").select(F.col("to_concept").alias("from_concept"), F.col("from_concept").alias("to_concept"), "relation_type")
    return relations.unionByName(back).dropDuplicates()


def confusable_clash(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """(phrase_norm, tier, clashes) where two candidates of a tier must not be merged."""
    pair = mirror(relations).filter("relation_type = 'CONFUSABLE_DO_NOT_MERGE' and from_concept < to_concept")
    a = candidates.select("phrase_norm", "tier", F.col("concept_id").alias("from_concept"))
    b = candidates.select("phrase_norm", "tier", F.col("concept_id").alias("to_concept"))
    hit = a.join(pair, "from_concept").join(b, ["phrase_norm", "tier", "to_concept"], "left_semi")
    return hit.groupBy("phrase_norm", "tier").agg(F.array_sort(F.collect_set(F.concat_ws("|", "from_concept", "to_concept"))).alias("clashes"))


def type_reject(candidates: DataFrame, allowed: list[str] | None) -> DataFrame:
    """(phrase_norm, tier) of trigram and vector tiers whose selection has a type that isn't allowed."""
    if allowed is None:
        return candidates.select("phrase_norm", "tier").limit(0)
    return candidates.filter(F.col("selected") & (F.col("tier") >= 3) & ~F.col("concept_type").isin(*allowed)).select("phrase_norm", "tier").distinct()


def resolve(phrases: DataFrame, tiers: list[DataFrame], relations: DataFrame, allowed: list[str] | None = None, read_only: bool = False) -> DataFrame:
    """(phrase_norm, outcome, tier, concept_ids, confidence): the first terminal tier, else the best near miss.

    A batch is resolved against one snapshot. Read-only resolution never escalates.
    """
    cand = reduce(DataFrame.unionByName, tiers)
    guarded = F.col("selected") & (F.col("tier") >= 3)
    wrong = F.lit(False) if allowed is None else F.coalesce(F.bool_or(guarded & ~F.col("concept_type").isin(*allowed)), F.lit(False))
    rows = cand.groupBy("phrase_norm", "tier", "accept").agg(
        F.max(F.when(F.col("selected"), F.col("confidence"))).alias("confidence"), F.array_sort(F.collect_set(F.when(F.col("selected"), F.col("concept_id")))).alias("concept_ids"),
        F.array_sort(F.collect_set("concept_id")).alias("_all"), wrong.alias("refused"),
    )
    # the candidates of a tier are few, so their pairs are made in place; candidates aren't computed again for the guards
    others = lambda x, i: F.transform(F.slice("_all", i + 2, F.size("_all")), lambda y: F.struct(x.alias("from_concept"), y.alias("to_concept")))
    pairs = rows.filter(F.size("_all") > 1).select("phrase_norm", "tier", F.inline(F.flatten(F.transform("_all", others))))
    apart = mirror(relations).filter("relation_type = 'CONFUSABLE_DO_NOT_MERGE' and from_concept < to_concept").select("from_concept", "to_concept")
    clash = pairs.join(apart, ["from_concept", "to_concept"], "left_semi").select("phrase_norm", "tier", F.lit(True).alias("clash")).distinct()
    rows = rows.join(clash, ["phrase_norm", "tier"], "left")
    event = F.when(F.col("clash"), F.lit("UNRESOLVED" if read_only else "ESCALATED")).when(F.col("refused"), F.lit(None)).when(F.col("confidence") >= F.col("accept"), "RESOLVED").otherwise("NEAR")
    rows = rows.withColumn("event", event).filter("event is not null")
    said = F.struct("event", "tier", "concept_ids", "confidence")
    done = rows.groupBy("phrase_norm").agg(
        F.min_by(F.when(F.col("event") != "NEAR", said), F.when(F.col("event") != "NEAR", F.col("tier"))).alias("end"),
        F.max_by(F.when(F.col("event") == "NEAR", said), F.when(F.col("event") == "NEAR", F.struct("confidence", -F.col("tier")))).alias("near"),
    )
    best = F.coalesce("end", "near")
    out = phrases.select("phrase_norm").distinct().join(done, "phrase_norm", "left")
    outcome = F.when(F.col("end").isNotNull(), F.col("end.event")).when(F.col("near").isNotNull() & F.lit(not read_only), "NEAR_MISS").otherwise("UNRESOLVED")
    return out.select("phrase_norm", outcome.alias("outcome"), best["tier"].alias("tier"), best["concept_ids"].alias("concept_ids"), best["confidence"].alias("confidence"))


def probe_cache(phrases: DataFrame, cache: DataFrame, revision: int, relations: DataFrame) -> DataFrame:
    """Cached answers of this ontology revision whose candidates don't clash now."""
    good = cache.filter(F.col("ontology_revision").eqNullSafe(revision) & F.col("candidate_ids").isNotNull())
    cands = good.select("phrase_norm", F.lit(0).alias("tier"), F.explode("candidate_ids").alias("concept_id"))
    bad = confusable_clash(cands, relations).select("phrase_norm")
    return phrases.join(good, "phrase_norm").join(bad, "phrase_norm", "left_anti")


def decide_near(near: DataFrame, proposals: DataFrame, now, cap: int = WEEKLY_CAP) -> DataFrame:
    """Near misses with an impact are escalated in the order of their arrival, as far as the week's cap goes; the others are logged.

    proposals (decision, created_at) say how many were escalated in the seven days before now (a column). At most
    cap rows are ranked, so no task gets all near misses.
    """
    used = proposals.filter((F.col("decision") == "ESCALATED") & (F.col("created_at") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("created_at") <= now)).agg(F.count(F.lit(1)).alias("_used"))
    first = near.filter("impact > 0").orderBy("arrived_at", "phrase_norm").limit(cap).withColumn("_rn", F.row_number().over(W.orderBy("arrived_at", "phrase_norm")))
    top = first.crossJoin(F.broadcast(used)).filter(F.col("_rn") <= cap - F.col("_used")).select("phrase_norm", F.lit("ESCALATED").alias("decision"))
    return near.join(F.broadcast(top), "phrase_norm", "left").withColumn("decision", F.coalesce("decision", F.lit("LOGGED")))


def terminal_proposals(unresolved: DataFrame, concepts: DataFrame) -> DataFrame:
    """unresolved: phrase, allowed_types. One proposal for each key; a taken key of another name is disambiguated."""
    n = F.size(F.coalesce("allowed_types", F.array().cast("array<string>")))
    out = unresolved.withColumn("kind", F.when(n > 1, "NEEDS_TYPE").otherwise("AUTO_CREATE"))
    out = out.withColumn("concept_type", F.when(n == 1, F.col("allowed_types")[0]).when(n == 0, "PHYSIOLOGY")).withColumn("canonical_key", key_for(F.col("phrase")))
    have = concepts.select("canonical_key", norm_phrase(F.col("canonical_name")).alias("have_norm"))
    out = out.join(have, "canonical_key", "left")
    same = F.col("have_norm") == norm_phrase(F.col("phrase"))
    out = out.withColumn("action", F.when(F.col("kind") == "NEEDS_TYPE", "NONE").when(same, "REUSE").otherwise("CREATE"))
    return out.withColumn("canonical_key", F.when(F.col("have_norm").isNotNull() & ~same, disambiguate(F.col("canonical_key"), F.col("phrase"))).otherwise(F.col("canonical_key"))).drop("have_norm")


def split_aliases(c):
    """Column: name and aliases of `name (X)` and `a / b`, without aliases equal to the name."""
    name = F.btrim(F.regexp_replace(F.split(c, r"\s+/\s+")[0], r"\s*\([^)]*\)\s*$", ""))
    inner = F.transform(F.regexp_extract_all(c, F.lit(r"\(([^)]+)\)"), F.lit(1)), F.btrim)
    other = F.transform(F.slice(F.split(c, r"\s+/\s+"), 2, 99), lambda x: F.btrim(F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")))
    return F.struct(name.alias("name"), F.array_distinct(F.filter(F.concat(inner, other), lambda a: (F.lower(a) != F.lower(name)) & (a != ""))).alias("aliases"))


def seed_ontology(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """terms (domain, term): one row per key with its action REUSE or INSERT and its domains; short names are skipped."""
    t = terms.withColumn("s", split_aliases(F.col("term"))).select("domain", F.col("s.name").alias("name"), F.col("s.aliases").alias("aliases")).filter(F.length("name") >= 3)
    t = t.withColumn("canonical_key", key_for(F.col("name"))).withColumn("name_norm", norm_phrase(F.col("name")))
    t = t.groupBy("canonical_key").agg(F.min("name_norm").alias("name_norm"), F.min("name").alias("name"), F.array_sort(F.collect_set("domain")).alias("domains"))
    by_key = concepts.select("canonical_key", F.lit(True).alias("has_key"))
    by_name = concepts.select(norm_phrase(F.col("canonical_name")).alias("name_norm"), F.lit(True).alias("has_name")).distinct()
    out = t.join(by_key, "canonical_key", "left").join(by_name, "name_norm", "left")
    return out.select("canonical_key", "name", "domains", F.when(F.coalesce("has_key", "has_name", F.lit(False)), "REUSE").otherwise("INSERT").alias("action"))


def alias_collisions(aliases: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases that stay, and confusable relations for those equal to another concept's name."""
    names = concepts.select(F.col("concept_id").alias("to_concept"), norm_phrase(F.col("canonical_name")).alias("alias_norm"))
    bad = aliases.filter("method = 'SEED'").join(names, "alias_norm").filter("concept_id <> to_concept")
    made = bad.select(F.col("concept_id").alias("from_concept"), "to_concept", F.lit("CONFUSABLE_DO_NOT_MERGE").alias("relation_type")).distinct()
    return aliases.join(bad.select("alias_id"), "alias_id", "left_anti"), mirror(made)


def generate_confusable(concepts: DataFrame, block: str = "domain") -> DataFrame:
    """Pairs a < b of one domain whose names are alike but not the same; concepts: concept_id, name, domain."""
    a = concepts.select(F.col("concept_id").alias("a"), "name", block)
    b = concepts.select(F.col("concept_id").alias("b"), "name", block)
    return gram_pairs(a, b, "a", "b", CONFUSABLE_LOW, [block], CONFUSABLE_HIGH, ordered=True)


def concept_domains(concepts: DataFrame, domains: DataFrame) -> DataFrame:
    found = concepts.select("concept_id", F.explode(F.regexp_extract_all("origin_detail", F.lit(r"DOMAIN ([A-Z])(?![A-Z])"), F.lit(1))).alias("domain_code"))
    return found.join(F.broadcast(domains.select("domain_code", "domain_id")), "domain_code").select("concept_id", "domain_id").distinct()


def active_concepts(concepts: DataFrame) -> DataFrame:
    parents = concepts.select(F.col("concept_id").alias("parent_concept_id"), F.col("canonical_key").alias("parent_key"))
    return live(concepts).join(parents, "parent_concept_id", "left")


def ontology_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Concepts whose change can change an answer: INSERTED, DELETED or CHANGED among the live ones."""
    cols = ["canonical_name", "canonical_key", "concept_type", "merged_into"]
    a = live(old).select("concept_id", F.struct(*cols).alias("was"))
    b = live(new).select("concept_id", F.struct(*cols).alias("now"))
    both = a.join(b, "concept_id", "full").filter(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("concept_id", F.when(F.col("was").isNull(), "INSERTED").when(F.col("now").isNull(), "DELETED").otherwise("CHANGED").alias("change"))


def verdicts(rows: DataFrame) -> DataFrame:
    """rows: phrase, expected, to, must_not, tolerable, got (arrays of names): one of seven labels each."""
    got, to = F.col("got"), F.col("to")
    wrong = F.arrays_overlap(got, F.col("must_not"))
    strange = F.size(F.array_except(got, F.concat("to", "tolerable"))) > 0
    label = (
        F.when(wrong, "WRONG").when((F.size(got) == 0) & (F.col("expected") == "NO_MATCH"), "REFUSED").when(F.size(got) == 0, "MISSED")
        .when(strange, "WRONG").when((F.size(F.array_except(to, got)) == 0) & (F.col("expected") == "RESOLVE"), "RIGHT")
        .when(F.arrays_overlap(got, to), F.when(F.col("expected") == "PARTIAL", "PARTIAL").otherwise("PARTIAL_MISS")).otherwise("BROADER")
    )
    return rows.withColumn("verdict", label)


def sweep(neighbours: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per threshold: admitted top-1 neighbours and how many of each verdict; neighbours: phrase, score, verdict."""
    rows = neighbours.join(F.broadcast(thresholds), F.col("score") >= F.col("threshold"))
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("RIGHT", "PARTIAL", "BROADER", "WRONG")]
    return thresholds.join(rows.groupBy("threshold").agg(F.count(F.lit(1)).alias("admitted"), *counts), "threshold", "left").fillna(0)
