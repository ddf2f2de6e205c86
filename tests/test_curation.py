"""Evidence, decisions, curated cards, contracts and streaming state on tiny frames."""

import json
import random

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import curation, library, resolve, retrieval
from tessera.streaming import jobs


def test_evidence(spark):
    records = [
        {"citation": " A ", "design": "rct", "relationship": "Supports", "publication_year": 2001, "sample_size": "30", "doi": "10.1/X"},
        {"citation": "B", "design": "guess", "publication_year": "2001", "sample_size": 4.5, "url": "u"},
        {"citation": "C"}, {"citation": ""}, {"design": "RCT"},
    ]
    raw = spark.createDataFrame([(1, json.dumps(records)), (2, None), (3, "no json"), (4, "[]")], "claim_id int, records string")
    items = spark.createDataFrame([("i1", "10.1/x", None, None), ("i2", None, None, "v")], "item_id string, doi string, pmid string, url string")
    got = {r.citation: r for r in curation.land_evidence(raw, items).collect()}
    assert sorted(got) == ["A", "B", "C"]
    assert (got["A"].design, got["A"].relationship, got["A"].publication_year, got["A"].sample_size, got["A"].item_id, got["A"].study) == ("RCT", "SUPPORTS", 2001, None, "i1", "KNOWN")
    assert (got["B"].design, got["B"].relationship, got["B"].publication_year, got["B"].sample_size, got["B"].study) == ("OTHER", "NEUTRAL", None, None, "NEW")
    assert got["C"].study == "NONE" and got["C"].item_id is None


def test_decisions(spark):
    strategies = spark.createDataFrame([("s1", "one", "a", None, "LIMITED", "APPROVED")], "strategy_id string, name string, summary string, mechanism string, evidence_confidence string, knowledge_status string")
    rows = [
        (1, "create", None, "One", None, "b", None), (2, "UPDATE", "s1", None, None, None, "m"), (3, "CREATE", None, "two", "strong", "c", None), (4, "CREATE", None, "Two", None, None, "n"),
        (5, "UPDATE", "s9", None, None, "x", None), (6, "CREATE", None, " ", None, "x", None), (7, "MERGE", "s1", None, None, None, None), (8, "NO_CHANGE", None, None, None, None, None), (9, "PONDER", None, None, None, None, None), (10, None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, "decision_id int, decision string, strategy_id string, name string, evidence_confidence string, summary string, mechanism string")
    hits = spark.createDataFrame([(1, "s1")], "decision_id int, strategy_id string")
    after, outcomes = curation.apply_decisions(d, strategies, hits, ["summary", "mechanism"])
    assert {r.decision_id: r.outcome for r in outcomes.collect()} == {1: "UPDATE", 2: "UPDATE", 3: "CREATE", 4: "UPDATE", 5: "REFUSED", 6: "REFUSED", 7: "MERGE", 8: "NO_CHANGE", 9: "REFUSED", 10: "REFUSED"}
    got = {r.strategy_id: (r.name, r.summary, r.mechanism, r.evidence_confidence, r.knowledge_status) for r in after.collect()}
    assert got == {"s1": ("one", "b", "m", "LIMITED", "APPROVED"), "new-3": ("two", "c", "n", "STRONG", "AI_DISCOVERED_CANDIDATE")}


def test_concept_links(spark):
    phrases = spark.createDataFrame([("s", "Insulin ", "mechanism"), ("s", "insulin", "odd"), ("s", "unknown", None), ("s", " ", None), ("s", None, None)], "strategy_id string, phrase string, role string")
    found = spark.createDataFrame([("insulin", ["c1", "c2"]), ("unknown", [])], "phrase_norm string, concept_ids array<string>")
    links, none = curation.link_concepts(phrases, found, spark.createDataFrame([("s", "c1", "TARGETS")], "strategy_id string, concept_id string, link_role string"))
    assert sorted(map(tuple, links.select("strategy_id", "concept_id", "link_role").collect())) == [("s", "c1", "MECHANISM"), ("s", "c2", "MECHANISM"), ("s", "c2", "TARGETS")]
    assert [tuple(r) for r in none.collect()] == [("s", "unknown")]


def test_cards_and_units_stand_at_their_spans(spark):
    text = "intro\n# Walking — 🙂\n\n take **short walks** after meals. \n## Why\n- **Muscle**: x\n- Uptake: glucose\n## Empty\n\n# Rest\nsleep"
    docs = spark.createDataFrame([(1, text), (2, "no heading"), (3, "")], "doc_id int, text string")
    blocks = library.heading_blocks(docs, "doc_id", "text")
    blocks = library.attach_owners(blocks.withColumn("block_kind", F.when(F.col("level") == 1, "STRATEGY").otherwise("SUBSECTION"))).withColumn("field_name", F.lower("heading"))
    cards, fields = curation.cards(docs, blocks)
    got = {r.name: r for r in cards.collect()}
    assert sorted((r.name, r.n_fields) for r in got.values()) == [("Rest", 1), ("Walking — 🙂", 2)]
    assert text[got["Walking — 🙂"].source_start :].startswith("# Walking") and text[: got["Walking — 🙂"].source_end].endswith("## Empty\n\n")
    for r in fields.collect():
        assert text[r.source_start : r.source_end] == r.value and r.value == r.value.strip()
    rules = [("BOLD", "BOLD_RUN", r"\*\*(?P<unit>[^*]+?)\*\*", None), ("BULLET", "BULLET_LABEL", r"^[ \t]*[-*+][ \t]+(?P<unit>[^:\n]+?)[ \t]*:[ \t]+\S", ("why",))]
    units = curation.units(fields, rules).collect()
    assert sorted((u.rule_id, u.phrase) for u in units) == [("BOLD", "Muscle"), ("BOLD", "short walks"), ("BULLET", "**Muscle**"), ("BULLET", "Uptake")]
    assert all(text[u.source_start : u.source_end] == u.phrase for u in units)
    assert curation.units(fields.limit(0), rules).count() == 0


def test_name_shapes(spark):
    rows = spark.createDataFrame([(p,) for p in ("short walks", " ", None, "so:", "Eat this.", "of the", "a → b")], "phrase string")
    got = {r.phrase: r.reason for r in curation.name_shape(rows).collect()}
    assert got == {"short walks": None, " ": "empty", None: "empty", "so:": "ends in a colon", "Eat this.": "contains .", "of the": "stop words only", "a → b": "contains →"}


def test_links_are_only_replaced_with_authority(spark):
    docs = spark.createDataFrame([(k, "alpha beta") for k in range(5)], "doc_id int, text string")
    cards = spark.createDataFrame([("c0", 0, True), ("c1", 1, False), ("c2", 2, False), ("c3", 3, False), ("c4", 9, False)], "curated_id string, doc_id int, authoritative boolean")
    kind = "curated_id string, concept_id string, phrase string, source_start int, source_end int"
    prior = spark.createDataFrame([("c0", "x", "alpha", 0, 5), ("c2", "x", "alpha", 0, 5), ("c3", "x", "gamma", 0, 5)], kind)
    new = spark.createDataFrame([(c, "y", "beta", 6, 10) for c in ("c0", "c1", "c2", "c3")] + [("c1", None, "none", 0, 4), ("c1", "y", "beta", 6, 10)], kind)
    state, after = curation.reconcile_links(cards, prior, new, docs)
    assert {r.curated_id: tuple(r)[1:] for r in state.collect()} == {
        "c0": ("RECOMPUTED", 1, 0, 1), "c1": ("FIRST_ATTACHMENT", 1, 0, 0), "c2": ("NOT_RECOMPUTED", 0, 1, 0), "c3": ("FAILED_CLOSED", 0, 0, 1), "c4": ("FIRST_ATTACHMENT", 0, 0, 0)
    }
    assert sorted((r.curated_id, r.concept_id) for r in after.collect()) == [("c0", "y"), ("c1", "y"), ("c2", "x")]


def test_traces_and_case_knowledge(spark):
    cards = spark.createDataFrame([("k", "K"), ("l", "L")], "curated_id string, name string")
    links = spark.createDataFrame([("k", 9, "b"), ("k", 2, "a")], "curated_id string, source_start int, phrase string")
    got = {r.curated_id: r for r in curation.curated_trace(cards, links, links.limit(0)).collect()}
    assert [x.phrase for x in got["k"].concept_links] == ["a", "b"] and got["k"].fields == [] and got["l"].concept_links == []
    page = spark.createDataFrame([("q", "strategy", "1", 0.12345678, 1), ("q", "concept", "2", 0.1, 2), ("q", "pattern", "3", 0.1, 3)], "query_id string, kind string, id string, score double, rank int")
    out = curation.case_knowledge(page, {"strategy": spark.createDataFrame([(1, "S")], "id int, name string"), "pattern": spark.createDataFrame([(9, "P")], "id int, intervention string")}).orderBy("rank").collect()
    assert [(r.rank, r.score, r.knowledge, r.ranking_basis) for r in out] == [(1, 0.123457, '{"name":"S"}', "RELEVANCE_ONLY"), (3, 0.1, None, "RELEVANCE_ONLY")]


def test_contracts(spark):
    contract = {"required": ["a", "b"], "properties": {"a": {"type": "string", "minLength": 1}, "b": {"type": ["integer", "null"]}, "c": {"enum": ["x", "y"]}, "d": {"const": True}, "e": {"type": "number"}, "f": {"type": "array"}}, "additionalProperties": False}
    rows = ['{"a":"t","b":1}', '{"a":"","b":null,"c":"z","z":1}', '{"b":1.5,"d":false,"e":2,"f":[1]}', '{"a":"t","b":2,"d":true,"e":"2","f":{}}', "[]", "oops", None]
    got = [r.violations for r in curation.contract_violations(spark.createDataFrame([(r,) for r in rows], "control string").coalesce(1), contract).collect()]
    root = ["(root): expected type object"]
    assert got == [
        [], ["a: must not be empty", "c: not one of x, y", "z: not permitted by the contract"], ["a: required property missing", "b: expected type integer, null", "d: must be true"],
        ["e: expected type number", "f: expected type array"], root, root, root,
    ]


def test_escalations_keep_the_order_of_arrival(spark):
    near = spark.createDataFrame([("a", 9, 3), ("b", 1, 1), ("c", 0, 0), ("d", 5, 2)], "phrase_norm string, impact int, m int").selectExpr("phrase_norm", "impact", "timestamp'2024-01-10' + make_interval(0, 0, 0, 0, 0, m) AS arrived_at")
    past = spark.createDataFrame([("ESCALATED", "2024-01-04"), ("ESCALATED", "2024-01-02"), ("LOGGED", "2024-01-09")], "decision string, at string").selectExpr("decision", "cast(at AS timestamp) AS created_at")
    got = resolve.decide_near(near, past, F.lit("2024-01-10").cast("timestamp"), cap=3).collect()
    assert {r.phrase_norm: r.decision for r in got} == {"b": "ESCALATED", "d": "ESCALATED", "a": "LOGGED", "c": "LOGGED"}


def test_gram_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    names = [" ".join(rng.choice(["red", "reed", "read", "bolt", "bold", "gear", "gears", "", "x"]) for _ in range(3)) for _ in range(60)]
    table = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(names)], "id int, name string, domain int")

    def grams(n):
        return {f"  {w} "[i : i + 3] for w in n.split() for i in range(len(w) + 1)}

    want = set()
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            both = grams(a) | grams(names[j])
            if (i - j) % 2 == 0 and both and 0.45 <= len(grams(a) & grams(names[j])) / len(both) <= 0.85:
                want.add((i, j))
    got = resolve.generate_confusable(table.withColumnRenamed("id", "concept_id")).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_rerank_keeps_what_a_plain_ranking_would(spark):
    rng = random.Random(6)
    rows = [("q", "k", "%03d" % i, rng.randrange(40) / 40, sorted(rng.sample("abcdef", rng.randrange(3)))) for i in range(300)]
    got = retrieval.rerank(spark.createDataFrame(rows, "query_id string, kind string, id string, score double, buckets array<string>"), 12, 2).collect()
    order, place = sorted(rows, key=lambda r: (-r[3], r[2])), {}
    kept = []
    for r in order:
        own = r[4] or ["_none"]
        for b in own:
            place[b] = place.get(b, 0) + 1
        kept.append((min(place[b] for b in own) > 2, -r[3], r[2]))
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [x[2] for x in sorted(kept)[:12]]


def test_redacted_names_are_decoded(spark):
    urls = ["http://x/a?to%6Ben=s&b=%20#f?token=1", "http://x/a", "http://x/a?token", None, "http://x?sig=1&sig=2"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(X.redact_url(F.col("u"))).collect()]
    assert got == ["http://x/a?to%6Ben=REDACTED&b=%20#f?token=1", "http://x/a", "http://x/a?token", None, "http://x?sig=REDACTED&sig=REDACTED"]


def test_streams_carry_their_state_over_batches(spark, tmp_path):
    schema = "key string, at long, seq long, value string"
    batches = [[("u", 1, 1, "a"), ("u", 2, 2, "a"), ("v", 1, 3, "x"), ("u", 3, 4, "x")], [("u", 4, 5, "x"), ("v", 2, 6, "x"), ("v", 3, 7, "x")], [("u", 5, 8, "x"), ("u", 6, 9, "a"), ("v", 4, 10, "a")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    changed = jobs.landed(jobs.outcome_stream(source), str(tmp_path / "changes")).collect()
    assert sorted((r.seq, r.old_value, r.value) for r in changed) == [(1, None, "a"), (3, None, "x"), (4, "a", "x"), (9, "x", "a"), (10, "x", "a")]
    paused = jobs.landed(jobs.pause_stream(source.withColumn("ok", F.col("value") != "x"), 3), str(tmp_path / "pauses")).collect()
    assert sorted((r.key, r.seq) for r in paused) == [("u", 8), ("v", 7)]
    fed = jobs.landed(jobs.feed_stream(source.select(F.col("key").alias("source"), F.col("value").alias("guid"), F.col("at").alias("published"))), str(tmp_path / "feed")).collect()
    assert ("u", "a", 1) in {tuple(r) for r in fed}


def test_inbox_stream_gives_chunks_of_unknown_files(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for name, text in {"a": "one\n\ntwo", "b": "one\n\ntwo", "c": "old", "d": "x" * 3000 + "\n\n" + "y" * 3000}.items():
        (box / f"{name}.md").write_text(text)
    known = spark.createDataFrame([("old",)], "t string").select(F.sha2("t", 256).alias("sha256"))
    rows = jobs.landed(jobs.inbox_chunks(jobs.inbox_stream(spark, str(box), known)), str(tmp_path / "chunks")).collect()
    assert sorted((r.chunk_index, len(r.chunk)) for r in rows) == [(0, 8), (0, 3000), (1, 3000)]


def test_heaviest_concepts(spark):
    links = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0), ("a", 3, 0.5), ("b", 4, None), ("c", 5, 0.1)], "id string, concept_id int, weight double")
    assert {r.id: r.bucket for r in retrieval.heaviest_concepts(links).collect()} == {"a": "1", "c": "5"}
