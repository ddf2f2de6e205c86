"""Sightings, claim phrases and case queries on small frames."""

from tessera.operators import discovery


def test_items_are_identified_and_touched(spark):
    items = spark.createDataFrame(
        [(1, 7, "u1", None, "", "QUEUED", "old", 0), (2, 7, None, "g2", "T", "INGESTED", "kept", 0), (3, 8, "u3", "g3", "S", "FAILED", "x", 0)],
        "item_id int, source_id int, url string, external_id string, title string, ingestion_status string, access_note string, last_seen int",
    )
    new = spark.createDataFrame(
        [(7, "u1", "g2", 5, "N", "DISCOVERED", None), (7, None, "g2", 6, "M", "DISCOVERED", None), (9, None, "g2", 6, "M", "DISCOVERED", None), (7, None, None, 6, "M", "DISCOVERED", None), (7, "u1", None, 4, "L", "FAILED", "e")],
        "source_id int, url string, guid string, seen_at int, title string, status string, note string",
    )
    seen = discovery.identify_items(new, items)
    assert sorted((r.seen_at, r.item_id or 0) for r in seen.collect()) == [(4, 1), (5, 1), (6, 0), (6, 0), (6, 2)]
    got = {r.item_id: r for r in discovery.touch_items(items, seen).collect()}
    assert (got[1].title, got[1].external_id, got[1].ingestion_status, got[1].access_note, got[1].last_seen) == ("N", "g2", "DISCOVERED", None, 5)
    assert (got[2].title, got[2].ingestion_status, got[2].access_note, got[2].last_seen) == ("T", "INGESTED", "kept", 6)
    assert (got[3].ingestion_status, got[3].access_note, got[3].last_seen) == ("FAILED", "x", 0)


def test_claim_phrases_and_case_queries(spark):
    cards = spark.createDataFrame([(1, " a ", "b"), (1, "b", None), (2, None, " ")], "envelope_id int, target string, intervention string")
    phrases = discovery.claim_phrases(cards, ["target", "intervention"])
    assert sorted((r.phrase, r.field or "") for r in phrases.collect()) == [("a", "target"), ("b", "")]
    assert [tuple(r) for r in discovery.claim_census(phrases, phrases.filter("phrase = 'a'")).collect()] == [(1, 2, 1, 1)]
    controls = spark.createDataFrame([(1, ["p", "q"], ["why"]), (2, [], None), (3, None, None)], "case_id int, phrases array<string>, questions array<string>")
    found = spark.createDataFrame([("p", ["z", "y"]), ("q", ["y"])], "phrase string, concept_ids array<string>")
    got = {r.case_id: (r.query_text, r.concept_ids) for r in discovery.case_queries(controls, found).collect()}
    assert got == {1: ("p q why", ["y", "z"]), 2: (None, []), 3: (None, [])}
