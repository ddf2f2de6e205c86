"""Readers, follow-up and foundation operators on tiny files and frames."""

import json

from pyspark.sql import functions as F

from tessera.operators import followup, foundation
from tessera.sources import readers


def test_readers(spark, tmp_path):
    rates = {"_c": "note", "prices": {"m": {"input_usd_per_mtok": 1, "output_usd_per_mtok": 2}, "_x": {}, "n": {"modalities": {"image": {"input_usd_per_mtok": 3, "output_usd_per_mtok": 0}}}}}
    (tmp_path / "rates.json").write_text(json.dumps(rates, indent=1))
    got = readers.read_price_registry(spark, str(tmp_path / "rates.json")).collect()
    assert sorted(map(tuple, got)) == [("m", "TEXT", 1.0, 2.0), ("n", "IMAGE", 3.0, 0.0)]
    box = tmp_path / "box"
    box.mkdir()
    for name, text in {"a.md": "x", "a.md.meta.json": '{"title": "T"}', "b.txt": "y", "b.txt.meta.json": "no"}.items():
        (box / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.scan_inbox(spark, str(box)).collect()}
    assert got["a.md"].meta["title"] == "T" and got["a.md"].suffix == ".md" and got["a.md"].note is None and len(got) == 2
    (tmp_path / "t.json").write_text(json.dumps([{"url": "u", "transcript": [{"text": "a", "start": 0, "duration": 1}]}, {"url": "v"}, {"url": "w", "error": "e"}]))
    videos, segments = readers.read_transcripts(spark, str(tmp_path / "t.json"))
    assert [r.outcome for r in videos.orderBy("url").collect()] == ["OK", "NO_TRANSCRIPT", "ERROR"] and segments.count() == 1
    (tmp_path / "k.json").write_text(json.dumps({"phrases": [{"phrase": "p", "expected": "RIGHT", "to": ["a"]}]}))
    assert readers.read_answer_key(spark, str(tmp_path / "k.json")).first().to == ["a"]
    (tmp_path / "d.md").write_text("# A\nb\n")
    assert readers.read_markdown(spark, str(tmp_path / "d.md")).first().text == "# A\nb\n"


def test_feeds_and_searches(spark):
    rss = "<rss><channel><title>c</title><item><title>a</title><link>l</link></item><item><guid>g</guid></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>b</title><id>i</id><link href="h"/><updated>2026</updated></entry></feed>'
    got = readers.feed_entries(spark.createDataFrame([(1, rss), (2, atom), (3, None)], "id int, body string")).collect()
    assert sorted((r.id, r.title, r.url, r.guid, r.published) for r in got if r.url) == [(1, "a", "l", "l", None), (2, "b", "h", "i", "2026")] and len(got) == 3
    rows = spark.createDataFrame([(1, '{"esearchresult":{"idlist":["5","6"]}}'), (2, "{")], "q int, payload string")
    assert sorted((r.q, r.outcome, r.external_id) for r in readers.search_results(rows).collect()) == [(1, "OK", "5"), (1, "OK", "6"), (2, "MALFORMED", None)]


def test_landing_refuses_and_counts(spark):
    blocks = spark.createDataFrame([(1, '[{"name":" a ","tier":"primary"},{"name":" "},{"tier":"x"}]'), (2, "no"), (3, None)], "client_id int, items string")
    landed, refused = followup.land_plan_items(blocks)
    assert [(r.name, r.tier) for r in landed.collect()] == [("a", "PRIMARY")] and refused.first().refused == 2
    ints = spark.createDataFrame([(1, 7, "A", "STARTED"), (1, 8, "B", "STOPPED")], "client_id int, intervention_id int, name string, status string")
    out = spark.createDataFrame([(1, '[{"name":"a ","outcome":"odd"},{"name":"B"},{"name":null}]')], "client_id int, outcomes string")
    written, unmatched = followup.land_outcomes(out, ints)
    assert [tuple(r) for r in written.collect()] == [(1, 7, "NOT_TRACKED", "STARTED")] and unmatched.first().unmatched == 2


def test_foundation_small(spark):
    named = spark.createDataFrame([(1, "K", "x"), (2, "L", "green tea daily"), (3, "M", "other")], "name_id int, strategy_key string, name string")
    held = spark.createDataFrame([(10, "K", "zzz", "SUPPORTED"), (11, "N", "Green tea daily", "SUPPORTED"), (12, "M", "q", "DEPRECATED")], "strategy_id int, strategy_key string, name string, knowledge_status string")
    assert sorted((r.name_id, r.strategy_id) for r in foundation.collisions(named, held).collect()) == [(1, 10), (2, 11)]
    links = spark.createDataFrame([(5, 1), (5, 2), (6, 3)], "concept_id int, strategy_id int")
    concepts = spark.createDataFrame([(5, "green tea"), (6, "sleep")], "concept_id int, name string")
    got = foundation.impact(spark.createDataFrame([("green teas",), ("none",)], "phrase string"), links, concepts).collect()
    assert sorted(map(tuple, got)) == [("green teas", 2), ("none", 0)]
    cols = ", ".join(f"{c} string" for c in foundation.NEGATIVE)
    assert foundation.land_negative(spark.createDataFrame([("a",) * 5, ("a", " ", "a", "a", "a"), ("a", None, "a", "a", "a")], cols)).count() == 1
    claims = spark.createDataFrame([(1, "LOW"), (2, None)], "claim_id int, confidence string").drop("confidence")
    found = foundation.apply_assessment(claims, spark.createDataFrame([(1, " ", "strong"), (2, "f", "odd")], "claim_id int, finding string, confidence string"))
    assert [(r.finding != "", r.confidence) for r in found.orderBy("claim_id").collect()] == [(True, "STRONG"), (True, "UNKNOWN")]
    runs = spark.createDataFrame([("r1", "SUCCEEDED"), ("r2", "FAILED")], "run_id string, status string")
    outs = spark.createDataFrame([("r1", None, "{}"), ("r1", "T", '{"a":1}'), ("r2", None, "{}")], "run_id string, handoff_tag string, structured string")
    assert foundation.missing_handoffs(runs, outs).count() == 1
    ready = spark.createDataFrame([("a", 3, False), ("b", 5, False), ("c", 0, False), ("d", 6, True)], "domain_key string, dimensions_covered int, gap_assessment_complete boolean")
    assert [r.domain_key for r in foundation.gap_assess_queue(ready).collect()] == ["b", "a"]
    env = spark.createDataFrame([(1, "NORMALIZED", True, None, "k", 2), (2, "NORMALIZED", True, 1, "k", 1)], "envelope_id int, status string, extractable boolean, duplicate_of int, kind string, received_at int")
    assert foundation.extract_pending(env, spark.createDataFrame([("k", "MODEL")], "kind string, extractor string")).count() == 1
    aliases = foundation.learn_aliases(spark.createDataFrame([("A b", ["c1"], "RESOLVED", "TRIGRAM", 0.9)], "phrase string, selected array<string>, status string, method string, confidence double"), 0.85)
    assert aliases.select(F.col("confirmed")).first().confirmed
