"""Phrases in texts, English stems and nearest vectors."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.stem import STOP_WORDS, stem, stems
from tessera.operators import cases, curation, nearest, phrases, retrieval

# Published pairs of words and their stems.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consolation consol consolatory consolatori console consol consolidate consolid consolingly consol consonant conson conspicuous conspicu
conspiracy conspiraci conspirator conspir constable constabl constancy constanc knack knack knackeries knackeri knave knave knaves knave knavish knavish kneaded knead
kneeling kneel knew knew knick knick knife knife knightly knight knitting knit knives knive knocker knocker knopp knopp knots knot""".split()


@pytest.mark.parametrize("alphabet", ["ab", "abcd", "aé漢"])
def test_automaton_finds_every_phrase(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(60):
        own = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 20))})
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 300, 900]))) for _ in range(rng.randrange(0, 12))]
        data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in texts)])
        rows, which = phrases.Automaton([p.encode() for p in own]).find(data, offs)
        assert set(zip(rows.tolist(), which.tolist(), strict=True)) == {(i, j) for i, x in enumerate(texts) for j, p in enumerate(own) if p in x}


def test_a_hundred_thousand_names(spark):
    rng = random.Random(2)
    names = sorted({f"{rng.choice(['John', 'Mary', 'Customer#', 'Li'])} {rng.randrange(10**9):09d}" for _ in range(100_000)})
    picked = [rng.choice(names) for _ in range(300)]
    texts = [(i, f"the {rng.choice(['x', 'John 1', 'Customer# 000'])} seen by {n.upper()}s") for i, n in enumerate(picked)] + [(-1, "nobody"), (-2, None), (-3, "")]
    rows = spark.createDataFrame(texts, "k int, t string").repartition(3)
    clients = spark.createDataFrame([(f" {n} ", None) for n in names], "display_name string, external_ref string")
    for size in (phrases.PART_BYTES, 500_000):
        got = {(r.k, r.kind, r.phrase) for r in cases.scan_clients(rows, "k", "t", clients, size).collect()}
        assert got == {(i, "NAME", n.lower()) for i, n in enumerate(picked)}


def test_aggregates_that_name_a_client_are_refused(spark):
    clients = spark.createDataFrame([("Ann Lee", "REF-77"), (" Al ", "x1"), (None, None), ("50%_a", None)], "display_name string, external_ref string")
    rows = [(1, "five people", None), (2, "as ANN", "Lee said"), (3, "see ref-77b", ""), (4, "ann  lee", "al x1"), (5, "a@b.org", None), (6, None, None), (7, "of 50%_A", None), (8, "508za", None), (9, "wannann lees", None)]
    table = spark.createDataFrame(rows, "id int, summary string, drop_out string")
    assert sorted(r.id for r in cases.refuse_identified(table, "id", ["summary", "drop_out"], clients).collect()) == [1, 4, 6, 8]
    flags = {r.id: (r.has_name, r.has_reference, r.has_email) for r in cases.scan_identifiers(table, "id", "summary", clients).collect()}
    assert flags == {3: (False, True, False), 5: (False, False, True), 7: (True, False, False), 9: (True, False, False)}
    assert cases.scan_clients(table, "id", "summary", clients.limit(0)).count() == 0 and cases.scan_clients(table.limit(0), "id", "summary", clients).count() == 0


def test_published_stems():
    assert [stem(w) for w in PAIRS[::2]] == PAIRS[1::2]
    more = {"skies": "sky", "dying": "die", "news": "news", "generously": "generous", "communication": "communic", "cries": "cri", "ties": "tie", "gas": "gas", "hopping": "hop", "hoping": "hope", "inning": "inning"}
    assert {w: stem(w) for w in more} == more and stem("") == "" and stem("by") == "by" and stem("say's") == "say"


def test_stemmed_channel(spark):
    docs = spark.createDataFrame([(1, "Consigned goods consigning", "a"), (2, "the goodness of it", "b"), (3, None, "c"), (4, "knives", "d")], "id int, text string, bucket string")
    asked = spark.createDataFrame([("q", "consignment of the knives"), ("r", "the of and"), ("s", None)], "query_id string, text string")
    words = retrieval.query_stems(asked, "query_id", "text")
    assert sorted(map(tuple, words.collect())) == [("q", "consign"), ("q", "knive")]
    hits = retrieval.by_stems(words, retrieval.stem_postings(docs, "D", "id", "text", "bucket", words))
    labelled = retrieval.with_labels(hits, docs.select(F.lit("D").alias("kind"), "id", F.col("text").alias("label")), 9).collect()
    assert sorted((r.query_id, r.id, r.raw, r.label) for r in labelled) == [("q", "1", 2.0, "Consigned"), ("q", "4", 1.0, "knives")]
    assert stems(docs.select(F.lit(None).cast("string").alias("lexeme"))).count() == 0
    shaped = curation.name_shape(spark.createDataFrame([("before you",), ("knees",)], "phrase string"), stop_words=STOP_WORDS).collect()
    assert {r.phrase: r.reason for r in shaped} == {"before you": "stop words only", "knees": None}


def test_stemmed_channel_deals_texts_by_id_and_no_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "goods consigned and consigning", "a"), (1, "consign goods", "a"), (1, "consigns", "b"), (2, "knife", "a"), (3, None, None)], "id int, text string, bucket string")
    words = retrieval.query_stems(spark.createDataFrame([("q", "consignment of goods"), ("r", "good")], "query_id string, text string"), "query_id", "text")
    whole = retrieval.by_stems(words, retrieval.stem_postings(docs, "D", "id", "text", "bucket"))
    for sent in (retrieval.SENT_WORDS, 0):
        monkeypatch.setattr(retrieval, "SENT_WORDS", sent)
        hits = retrieval.by_stems(words, retrieval.stem_postings(docs, "D", "id", "text", "bucket", words))
        got = sorted((r.query_id, r.id, r.bucket, r.raw) for r in hits.collect())
        assert got == [("q", "1", "a", 5.0), ("q", "1", "b", 1.0), ("r", "1", "a", 2.0)] == sorted((r.query_id, r.id, r.bucket, r.raw) for r in whole.collect())
        plan = hits._jdf.queryExecution().executedPlan().toString()
        if sent:
            assert not re.search(r"hashpartitioning\([^)]*(lexeme|stem|query_id)[^)]*\bid#", plan) and re.search(r"hashpartitioning\(id#\d+, ", plan)


@pytest.mark.parametrize(("n", "m"), [(6, 90), (90, 6), (0, 5), (5, 0)])
@pytest.mark.parametrize("sent", [1 << 20, 160])
def test_nearest_equals_brute_force(spark, n, m, sent):
    rng = np.random.default_rng(n + m)
    unit = lambda x: (x / np.linalg.norm(x)).tolist()
    q, v = [(i, unit(rng.integers(-2, 3, 3) + 0.5)) for i in range(n)], [(f"v{i:02d}", unit(rng.integers(-2, 3, 3) + 0.5)) for i in range(m)]
    if m > 50:
        v[7], v[8], v[9] = ("v07", None), ("v08", [1.0]), ("v09", [1.0, None, 1.0])
    queries, vectors = spark.createDataFrame(q, "q int, embedding array<double>").repartition(2), spark.createDataFrame(v, "v string, embedding array<double>").repartition(3)
    dot = lambda a, b: round(max(0.0, float(np.dot(a, b))), 6) if len(b) == 3 and None not in b else 0.0
    want = []
    for i, a in q:
        ranked = sorted((-dot(a, b), j) for j, b in v if b is not None)[:4]
        want += [(i, j, -s, r) for r, (s, j) in enumerate(ranked, 1)]
    got = nearest.nearest(queries, vectors, "q", "v", 4, sent).collect()
    assert sorted((r.q, r.v, r.score, r["rank"]) for r in got) == sorted(want)


def test_nearest_has_no_cross_join(spark):
    rows = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    plan = nearest.nearest(rows.filter("id < 9").withColumnRenamed("id", "q"), rows, "q", "id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("few", [0, 64])
def test_classes_of_names_by_few_and_by_many_patterns(spark, monkeypatch, few):
    monkeypatch.setattr(cases, "FEW_PATTERNS", few)
    rows = [("INSULIN", "insulin", True), ("INSULIN", "Glar,  gine", True), ("OTHER", "in", True), ("OTHER", "met", False), ("ALL", " ", True)]
    patterns = spark.createDataFrame(rows, "match_class string, pattern string, active boolean")
    names = spark.createDataFrame([(1, "Insulin glargine"), (1, "Insulin glargine"), (2, "metformin"), (3, None), (4, "salt"), (5, "glar,gine")], "id int, name string")
    got = sorted(map(tuple, cases.match_class(names, patterns, "name").collect()))
    want = {(i, n, c) for i, n in [(1, "Insulin glargine"), (2, "metformin"), (4, "salt"), (5, "glar,gine")] for c, p in [("INSULIN", "insulin"), ("INSULIN", "glar gine"), ("OTHER", "in"), ("ALL", "")] if p in n.lower().replace(",", " ")}
    assert got == sorted(want)
