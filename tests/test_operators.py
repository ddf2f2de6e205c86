"""Operators on tiny frames: expected rows, reruns, edge cases."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import text as X
from tessera.operators import cases, ingest, library, resolve, retrieval, sinks, telemetry
from tessera.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "  Vitamin-D3 (25 OH)! ", X.norm_phrase) == "vitamin-d3 25 oh"
    assert one(spark, "1. blood sugar", X.canonical_key) == "BLOOD_SUGAR"
    assert one(spark, "日本", X.canonical_key) is None
    assert one(spark, "日本", X.key_for).startswith("PHRASE_")
    assert one(spark, None, X.norm_phrase) is None
    assert one(spark, "https://x/a?token=1&b=2&Key=", X.redact_url) == "https://x/a?token=REDACTED&b=2&Key="
    assert one(spark, "https://youtu.be/dQw4w9WgXcQ?t=3", X.video_id) == "dQw4w9WgXcQ"
    assert one(spark, "https://example.org", X.video_id) is None
    assert one(spark, "<p>a&amp;b</p><script>x</script><p>c", X.html_to_text) == "a&b\n\nc"
    assert one(spark, "data:image/png;base64,xx", X.is_embeddable) is False
    assert [one(spark, v, X.strict_number) for v in ("170d", "1.5", ".5", "", None)] == [None, 1.5, 0.5, None, None]
    assert [one(spark, v, X.strict_date) for v in ("2026-1-5", "2026-01-05", "2026-13-05")] == [None, dt.date(2026, 1, 5), None]
    assert [one(spark, v, X.adherence_band, "double") for v in (80.0, 50.0, 10.0, None)] == ["HIGH", "PARTIAL", "LOW", "UNKNOWN"]
    assert one(spark, "", X.estimate_tokens) == 1


def test_trigram_similarity_is_symmetric(spark):
    rows = spark.createDataFrame([("word", "two words"), ("", ""), ("abc", "abc")], "a string, b string")
    ga, gb = X.trigrams(F.col("a")), X.trigrams(F.col("b"))
    got = rows.select(X.trgm_similarity(ga, gb).alias("x"), X.trgm_similarity(gb, ga).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got]
    assert got[0].x == pytest.approx(4 / 11) and got[1].x == 0 and got[2].x == 1


def test_pairs_of_names_with_many_keys_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK_KEYS", 3)
    names = ["red bolt", "red bold", "red bolt", "new gear", None, ""]
    rows = [(k, names[k % 6], "d" if k % 5 else "e") for k in range(120)] + [(200, "red bolt", None), (201, "red bold", None)]
    concepts = spark.createDataFrame(rows, "concept_id long, name string, domain string")
    grams = lambda n: {("  " + w + " ")[i : i + 3] for w in n.split() for i in range(len(w) + 1)}
    want = []
    for i, a, d in rows:
        for j, b, e in rows:
            if i < j and d == e and d and a and b:
                sim = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
                want += [(i, j, d, sim)] if resolve.CONFUSABLE_LOW <= sim <= resolve.CONFUSABLE_HIGH else []
    pairs = resolve.generate_confusable(concepts)
    got = pairs.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b, r.domain, r.sim) for r in got) == sorted(want) and len(want) > 300
    assert len({r.task for r in got}) > 1
    same = resolve.gram_pairs(concepts.withColumnRenamed("concept_id", "a"), concepts.withColumnRenamed("concept_id", "b"), "a", "b", 1.0, ["domain"], ordered=True)
    assert same.count() == sum(a == b and d == e and i < j and bool(a and d) for i, a, d in rows for j, b, e in rows)


def test_sections_and_chunks(spark):
    text = "intro\n# A\none\n## B\ntwo\n# C\n\n### D\nthree"
    rows = ingest.segment_sections(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text").orderBy("id", "sec_no").collect()
    assert [(r.location, r.body) for r in rows] == [("(body)", "intro"), ("A", "one"), ("A > B", "two"), ("C > D", "three"), ("(body)", "")]
    paragraphs = ["x" * n for n in (1000, 1000, 1000, 3000, 100)]
    got = ingest.chunk_sections(spark.createDataFrame([("\n\n".join(paragraphs),)], "body string")).orderBy("chunk_index").collect()
    assert "".join(r.chunk for r in got).replace("\n", "") == "".join(paragraphs)
    assert [len(r.chunk) for r in got] == [2002, 1000, 3102]


def test_paragraphs_lose_blanks_and_no_digits(spark, tmp_path):
    texts = ["0997 a\n1219 b\n2 c2", "  x \n\t\u00a0y\u3000\u2003\n z", "a\n\x0b\nb\n\f\n\x85\n", "1\n1\n11", " \n \u00a0", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("ing03_chunks", "str01_inbox_store"):
        want = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        df = entry.queries()[name](spark, str(tmp_path))
        assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())
    got = ingest.chunk_sections(docs.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("body"))).collect()
    assert {r.doc_id: r.chunk for r in got} == {0: "0997 a\n\n1219 b\n\n2 c2", 1: "x\n\n\t\u00a0y\n\nz", 2: "a\n\n\x0b\n\nb\n\n\x85", 3: "1\n\n1\n\n11"}


def test_captions(spark):
    rows = [(1, 0, "so we start here", 0.0, 2.0), (1, 1, "Start here, and go", 1.0, 3.0), (1, 2, "and go", 5.0, 6.0)]
    got = ingest.dedupe_segments(spark.createDataFrame(rows, "id int, pos int, text string, start double, end double"), "id", "pos").orderBy("pos").collect()
    assert [(r.text, r.dropped_words) for r in got] == [("so we start here", 0), ("and go", 2), ("and go", 0)]
    blocks = ingest.pack_blocks(spark.createDataFrame([(1, 0.0, "a" * 700), (1, 1.0, "b" * 700), (1, 2.0, "c")], "id int, start double, text string"), "id").orderBy("block_no").collect()
    assert [(b.start, len(b.text)) for b in blocks] == [(0.0, 700), (1.0, 702)]


def test_identity_and_queues(spark):
    d = spark.createDataFrame([(3, "h"), (1, "h"), (2, "g")], "id int, h string")
    assert {r.id: r.duplicate_of for r in ingest.dedup_by_hash(d, "id", "h", "id").collect()} == {3: 1, 1: None, 2: None}
    v = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b")], "url string, at int, sha string")
    assert [r.source_version for r in ingest.version_by_url(v, "url", ["at"], "sha").orderBy("at").collect()] == [1, 1, 2]
    at = dt.datetime(2026, 1, 2)
    searches = spark.createDataFrame([("p", "Blood  sugar", at), ("q", "blood sugar", at)], "adapter string, query string, at timestamp")
    history = spark.createDataFrame([("p", "blood sugar ", dt.datetime(2026, 1, 1, 20)), ("q", "blood sugar", at)], "adapter string, query string, executed_at timestamp")
    adapters = spark.createDataFrame([("p", 12), ("q", 0)], "adapter string, repeat_after_hours int")
    assert [r.adapter for r in ingest.suppress_recent(searches, history, adapters).collect()] == ["q"]
    r = ingest.normalise_rights(spark.createDataFrame([("ODD",), (None,), ("PRIVATE",)], "rights string")).collect()
    assert [(x.rights, x.excerpt_only) for x in r] == [("PUBLIC", False), ("PUBLIC", False), ("PRIVATE", True)]


def test_writes_are_idempotent(spark):
    target, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    first = sinks.upsert(target, new, ["k"])
    assert sorted(first.collect()) == sorted(sinks.upsert(first, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.insert_absent(first, new, ["k"]).count() == 0


def ontology(spark):
    concepts = spark.createDataFrame(
        [("c1", "INSULIN_RESISTANCE", "insulin resistance", "PHYSIOLOGY", "ACTIVE", [1.0, 0.0]), ("c2", "INSULIN_SENSITIVITY", "insulin sensitivity", "PHYSIOLOGY", "SEEDED", [0.6, 0.8]), ("c3", "OLD", "old name", "FOOD", "MERGED", None)],
        "concept_id string, canonical_key string, canonical_name string, concept_type string, status string, embedding array<double>",
    ).withColumn("merged_into", F.lit(None).cast("string"))
    aliases = spark.createDataFrame([("a1", "c1", "IR", "ir", "SEED", True)], "alias_id string, concept_id string, alias_text string, alias_norm string, method string, confirmed boolean")
    relations = spark.createDataFrame([("c2", "c1", "CONFUSABLE_DO_NOT_MERGE")], "from_concept string, to_concept string, relation_type string")
    return concepts, aliases, relations


def test_cascade(spark):
    concepts, aliases, relations = ontology(spark)
    phrases = spark.createDataFrame([("ir",), ("insulin resistanc",), ("old name",), ("vec",), ("both",)], "phrase_norm string")
    vectors = spark.createDataFrame([("vec", [1.0, 0.0]), ("both", [0.95, 0.3122])], "phrase_norm string, embedding array<double>")
    tiers = [resolve.tier_alias(phrases, aliases, concepts), resolve.tier_trigram(phrases, concepts, aliases), resolve.tier_semantic(vectors, concepts)]
    got = {r.phrase_norm: (r.outcome, r.concept_ids) for r in resolve.resolve(phrases, tiers, relations.limit(0)).collect()}
    assert got["ir"] == ("RESOLVED", ["c1"]) and got["vec"] == ("RESOLVED", ["c1"]) and got["old name"][0] == "UNRESOLVED"
    assert got["insulin resistanc"][0] in ("NEAR_MISS", "RESOLVED")
    guarded = {r.phrase_norm: r.outcome for r in resolve.resolve(phrases, tiers, relations).collect()}
    assert guarded["both"] == "ESCALATED" and guarded["ir"] == "RESOLVED"
    silent = {r.phrase_norm: r.outcome for r in resolve.resolve(phrases, tiers, relations, ["FOOD"], read_only=True).collect()}
    assert set(silent.values()) <= {"RESOLVED", "UNRESOLVED"} and silent["vec"] == "UNRESOLVED"


def test_ontology_upkeep(spark):
    concepts, aliases, relations = ontology(spark)
    assert resolve.mirror(relations).count() == 2
    s = spark.createDataFrame([("Vitamin D (calciferol) / D vitamin",), ("plain",)], "c string").select(resolve.split_aliases(F.col("c")).alias("s")).collect()
    assert (s[0].s.name, s[0].s.aliases) == ("Vitamin D", ["calciferol", "D vitamin"]) and s[1].s.aliases == []
    seeded = {r.canonical_key: r.action for r in resolve.seed_ontology(spark.createDataFrame([("A", "insulin resistance"), ("B", "Fibre"), ("B", "ab")], "domain string, term string"), concepts).collect()}
    assert seeded == {"INSULIN_RESISTANCE": "REUSE", "FIBRE": "INSERT"}
    new = concepts.filter("concept_id <> 'c2'")
    assert [(r.concept_id, r.change) for r in resolve.ontology_changed(concepts, new).collect()] == [("c2", "DELETED")]


def greedy(rows, limit, cap):
    used, first, deferred = {}, [], []
    for r in rows:
        buckets = r[1] or ["_none"]
        if all(used.get(b, 0) >= cap for b in buckets):
            deferred.append(r)
        else:
            first.append(r)
            for b in buckets:
                used[b] = used.get(b, 0) + 1
    return [r[0] for r in (first + deferred)[:limit]]


def test_rerank_equals_the_greedy_loop(spark):
    rng = random.Random(3)
    data, want = [], {}
    for q in range(40):
        rows = [(f"{i:02}", [f"b{b}" for b in rng.sample(range(4), rng.randrange(3))]) for i in range(rng.randrange(1, 25))]
        want[q] = greedy(rows, 10, 3)
        data += [(q, "K", i, 1.0 - n / 100, b) for n, (i, b) in enumerate(rows)]
    page = retrieval.rerank(spark.createDataFrame(data, "query_id int, kind string, id string, score double, buckets array<string>"), 10, F.lit(3))
    got = {}
    for r in page.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_channel_weights(spark):
    hits = spark.createDataFrame([(1, "K", "a", "b", "fts", 2.0), (1, "K", "a", "b", "vector", 0.5), (2, "K", "a", "b", "fts", 0.0)], "query_id int, kind string, id string, bucket string, channel string, raw double")
    got = {(r.query_id, r.channel): round(r.weight, 4) for r in retrieval.channel_weights(hits).collect()}
    assert got == {(1, "fts"): 0.5, (1, "vector"): 0.5, (2, "fts"): 1.0}
    assert {r.score for r in retrieval.normalise_scores(hits).filter("query_id = 2").collect()} == {0.0}


def test_pricing(spark):
    calls = spark.createDataFrame([(1, "m-pro-2", "TEXT"), (2, "m-pro", None), (3, "m-image", None), (4, "zzz", "TEXT")], "call_id int, model_name string, modality string").withColumn("input_tokens", F.lit(1000000)).withColumn("output_tokens", F.lit(0))
    prices = spark.createDataFrame([("m", "TEXT", 1.0, 1.0), ("m-pro", "TEXT", 2.0, 1.0), ("m-image", "IMAGE", 5.0, 1.0)], "model_name string, modality string, in_rate double, out_rate double")
    got = {r.call_id: (r.price_source, r.cost_usd) for r in telemetry.price_calls(calls, prices).collect()}
    assert got == {1: ("PREFIX", 2.0), 2: ("EXACT", 2.0), 3: ("UNPRICED", None), 4: ("UNPRICED", None)}


def test_blocks_of_model_text(spark):
    out = telemetry.extract_blocks(spark.createDataFrame([("x <R>```\nNAME: a\n more\nKIND: b\n```</R>",)], "text string"), ["R", "S"]).first()
    assert [(f.k, f.v) for f in out.fields] == [("NAME", "a more"), ("KIND", "b")]


def test_safety_rules(spark):
    meds = spark.createDataFrame([(1, "Insulin glargine", "CURRENT"), (2, "Metformin", "CURRENT")], "client_id int, name string, status string")
    ints = spark.createDataFrame([(1, "Low carb diet", "STARTED", None), (2, "Low carb diet", "STARTED", None)], "client_id int, name string, status string, outcome string")
    pats = spark.createDataFrame([("HYPO", "insulin", True), ("LOWERING", "low carb", True)], "match_class string, pattern string, active boolean")
    found = cases.rule_pair(meds, ints, pats, "HYPO", "LOWERING", "HYPO")
    assert [r.client_id for r in found.collect()] == [1]
    flags = spark.createDataFrame([(1, "HYPO", "OPEN")], "client_id int, rule_key string, status string")
    assert cases.apply_rules([found], flags).count() == 0
    assert cases.scoped(meds, None).count() == 0 and cases.scoped(meds, 1).count() == 1


TIED = [(1, 7, "2024-01-02", 5, "A", 60.0), (1, 7, "2024-01-02", 5, "N", 30.0), (1, 7, "2024-01-02", 5, "N", None), (1, 7, "2024-01-02", 4, "R", 99.0), (1, 7, "2024-01-01", 9, "R", 99.0), (1, 8, "2024-01-01", 1, None, None)]


def test_tied_observations_do_not_depend_on_the_order_of_rows(spark):
    for rows in (TIED, TIED[::-1], TIED[1:] + TIED[:1]):
        df = spark.createDataFrame(rows, "strategy int, client_id int, recorded_at string, intervention_id int, outcome string, adherence double").coalesce(1)
        assert sorted(map(tuple, cases.observations(df).collect())) == [(1, 7, "N", 30.0), (1, 8, None, None)]


def test_summary_of_tied_observations_does_not_depend_on_the_order_of_rows(spark):
    rows = [(s, c, *row) for _, c, *row in TIED for s, c in [(1, c * 10 + k) for k in range(5)]]
    for ordered in (rows, rows[::-1]):
        df = spark.createDataFrame(ordered, "strategy int, client_id int, recorded_at string, intervention_id int, outcome string, adherence double").coalesce(1)
        got = cases.cohort_summary(cases.observations(df)).collect()
        assert [(r.outcome_counts, r.band_counts, r.people) for r in got] == [("N 5", "LOW 5, UNKNOWN 5", 10)]


def test_library(spark):
    raw = spark.createDataFrame([("e", '[{"text":" a ","claim_type":"ODD","confidence":2},{"text":""}]'), ("f", "not json")], "envelope_id string, cards string")
    assert [(r.text, r.claim_type, r.confidence) for r in library.land_claims(raw).collect()] == [("a", "OTHER", None)]
    links = spark.createDataFrame([("L", "x", "r1"), ("L", "y", "r1"), ("W", "x", "r2")], "strategy_id string, claim_id string, role string")
    merged = library.merge_links(spark.createDataFrame([("L", "W")], "loser string, winner string"), links, "claim_id")
    assert sorted(map(tuple, merged.collect())) == [("W", "x", "r2"), ("W", "y", "r1")]
    text = "# One\nbody\n## Why\nx\n# Two\n"
    blocks = library.heading_blocks(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text")
    assert [text[r.start : r.end].split("\n")[0] for r in blocks.orderBy("ord").collect()] == ["# One", "## Why", "# Two"]
    rules = spark.createDataFrame([("r1", "^one$", "STRATEGY", 1, 1, True), ("r2", "^why", "SUBSECTION", 2, 1, True)], "rule_id string, pattern string, block_kind string, heading_level int, priority int, active boolean")
    kinds = library.attach_owners(library.classify_headings(blocks, rules)).orderBy("ord").collect()
    assert [(r.block_kind, r.owner_ord) for r in kinds] == [("STRATEGY", None), ("SUBSECTION", 0), ("REVIEW_REQUIRED", None)]


def test_streams_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = jobs.run_once(jobs.daily_spend(stream), "spend", "complete")
    want = events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("spend"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    deduped = jobs.run_once(jobs.repeat_suppression(stream, "ts", "user_id", "365 days"), "once")
    assert deduped.count() == events.select("user_id").distinct().count()


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not (n[:2] == "op" and n[2].isdigit() or n == "pipeline")])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_candidates_of_all_claims_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    orders = [(k, rng.randrange(1, 45)) for k in range(200)]
    lines = [(rng.randrange(200), rng.randrange(30), rng.randrange(15)) for _ in range(700)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    customer, want = dict(orders), set()
    claims, strategies = {}, {}
    for order, part, supplier in lines:
        claims.setdefault(customer[order], set()).add(part)
        strategies.setdefault(supplier, set()).add(part)
    for claim, parts in claims.items():
        found = sorted((-len(parts & own), s) for s, own in strategies.items() if parts & own)
        want |= {(claim, s, -n) for n, s in found[:8]}
    got = entry.queries()["knw09_candidates_of_all"](spark, str(tmp_path)).select("claim_id", "strategy_id", "shared").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and len(claims) > 30
