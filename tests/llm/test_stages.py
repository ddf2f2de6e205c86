"""Stages on rows that share an id, on clashing names and on languages without a trigram."""

import collections
import random

from tessera.llm import exact_dedup, language_id, lm_score, minhash


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_near_dedup_judges_each_text_of_an_id(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (7, a + " x"), (7, b), (9, b + " y"), (9, c), (9, c), (3, c + " z"), (None, a), (5, None), (6, "")]
    left = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in left) == collections.Counter([(1, a), (7, b), (3, c + " z"), (None, a), (5, None), (6, "")])
    once = [(1, a), (7, a + " x"), (8, b), (9, b + " y"), (9, b + " y")]
    left = minhash.near_dedup(spark.createDataFrame(once, "doc_id int, text string")).collect()
    assert {(r.doc_id, r.text) for r in left} == {(1, a), (8, b)}


def test_languages_without_trigrams_have_no_counts(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 40), "en", "s") for i in range(60)] + [(100, "", "xx", "s"), (101, "12", "yy", "t"), (102, "a", "zz", None), (103, "b c", "zz", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert len(got) == len(rows) and all(got[i].language == "en" and got[i].accepted for i in range(60))
    assert not got[100].accepted and not got[101].accepted and got[102].accepted
    alone = language_id.identify(table.filter("doc_id in (100, 101)")).collect()
    assert len(alone) == 2 and not any(r.accepted for r in alone)


def test_only_the_most_frequent_languages_have_a_table(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rng = random.Random(6)
    greek = "".join(rng.choice("αβγδεζηθ ") for _ in range(600))
    rows = [(i, prose(rng, 40), lang, "s") for i, lang in enumerate(["en"] * 400 + ["fr"] * 300)] + [(9000, greek, "el", "s"), (9001, greek + "α", None, "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language_id.fit(table, "text", "lang")[0] == ["en", "fr"]
    got = {r.doc_id: r.accepted for r in language_id.identify(table).collect()}
    assert got[9000] and not got[9001]


def test_names_that_are_made_from_others_may_stand_beside(spark):
    rng = random.Random(7)
    names = ["_drop", "_drop_sha", "_drop_salt", "_sha", "_key", "_salt", "ws", "w", "v", "source", "lang", "number", "sha"]
    rows = [(i, prose(rng, 20), *("en" if n == "lang" else "s" for n in names)) for i in range(8)]
    rows += [(8, rows[3][1], *rows[3][2:]), (8, prose(rng, 20), *rows[3][2:])]
    table = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for stage, n in ((exact_dedup.exact_dedup, 9), (language_id.keep_identified, 10), (minhash.near_dedup, 9)):
        out = stage(table)
        assert out.columns == table.columns and out.count() == n
    assert lm_score.score_against(table, table).filter("n_scored > 0").count() == 9
