"""Ranked search against brute force."""

import collections
import math
import random
import re

import pytest

from tessera.llm import ranked_search

DOC = "doc_id long, text string, stratum string, m string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOC).repartition(3)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(rows, asked, best=10):
    terms = [(i, [t.translate(LOWER) for t in TERM.findall(x)]) for i, x in rows if i is not None and x is not None]
    terms = [(i, collections.Counter(t), len(t)) for i, t in terms if t]
    total, words = len(terms), sum(n for _, _, n in terms)
    df = collections.Counter(t for _, c, _ in terms for t in c)
    own = collections.defaultdict(set)
    for item, text in asked:
        if item is not None:
            own[item] |= {t.translate(LOWER) for t in TERM.findall(text or "")}
    out = []
    for item, ask in own.items():
        scored = []
        for i, tf, n in terms:
            m = 100 - 90 + 90 * n * total // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in ask if tf[t])
            scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:best], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("stratum", [3, 1024])
def test_search_equals_brute_force(spark, monkeypatch, stratum):
    monkeypatch.setattr(ranked_search, "STRATUM", stratum)
    rng = random.Random(stratum)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.choice([1, 5, 5, 5, 30, 200]))) for i in range(260)]
    rows += [(1000 + i, "The hot text, w1 w2 w77!") for i in range(90)]  # one length and one score for many
    asked = [(i, text(rng.randrange(1, 30))) for i in range(12)] + [(50, "the HOT text"), (51, "nothingness"), (52, "w1")]
    assert rows_of(ranked_search.ranked(docs(spark, rows), items(spark, asked))) == brute(rows, asked)


def test_search_in_blocks_of_items_and_of_an_index_that_is_kept(spark):
    rows = [(i, f"common w{i % 7} w{i % 5} w{i}") for i in range(60)]
    asked = [(i, f"w{i} common w{i % 5}") for i in range(20)]
    index, total = ranked_search.build_index(docs(spark, rows))
    assert total == 60
    assert rows_of(ranked_search.search(index, total, items(spark, asked), item_bytes=64)) == brute(rows, asked)
    assert rows_of(ranked_search.search(index, total, items(spark, asked), best=3)) == brute(rows, asked, 3)


def test_nulls_ties_repeats_long_texts_and_capitals(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, " .,-_ "), (4, "Ä ä é_漢字 A"), (5, "a b"), (5, "a b"), (7, "B a"), (8, "long " * 30000 + "a"), (9, "a.b,c;a1")]
    asked = [(1, "A b"), (1, "LONG"), (2, None), (3, "?!"), (None, "a"), (4, "ä 漢字"), (5, "a a a"), (6, "zzz")]
    assert rows_of(ranked_search.ranked(docs(spark, rows), items(spark, asked))) == brute(rows, asked)


def test_empty_tables(spark):
    for rows, asked in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])):
        found = ranked_search.ranked(docs(spark, rows), items(spark, asked))
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]
