"""Jaccard join against brute force over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import jaccard_join as jaccard

DOC = "doc_id long, text string, key string, n string"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOC).repartition(3)


def shingle_set(text):
    words = (text or "").encode().translate(LOWER).split()
    return {tuple(words)} if 0 < len(words) < 5 else set(zip(*(words[i:] for i in range(5)), strict=False)) if words else set()


def brute(rows):
    """Sorted (id, size, component) per row by comparing all pairs; rows of one id are one document."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is None or j is None or not x or not y:
                continue
            common = len(x & y)
            if 100 * common >= 80 * (len(x) + len(y) - common):
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    return sorted(((i, len(x), None if i is None else root(i)) for i, x in sets), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def changed(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [words[at], f"y{rng.randrange(10**6)}"]])
        words = words or ["z"]
    return words


def corpus(seed):
    """Texts of all sizes with near copies around the threshold, chains of them, and a passage that many share."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(n)]
    passage, rows = fresh(40), []
    for base in range(40):
        words = fresh(rng.choice([3, 4, 5, 6, 8, 9, 10, 14, 30, 60, 150]))
        for _ in range(rng.randrange(1, 6)):
            rows.append(" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
            words = changed(rng, words, rng.randrange(0, 1 + max(1, len(words) // 40) * 2))
    rows += [" ".join(fresh(rng.randrange(0, 60)) + passage + fresh(rng.randrange(0, 60))) for _ in range(30)]
    ids = rng.sample(range(10**6), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("limit", "block"), [(9, 3), (10**9, 4)])
def test_components_equal_brute_force(spark, monkeypatch, limit, block):
    monkeypatch.setattr(jaccard, "PAIRS", 1 << block)
    rows = corpus(block)
    if limit == 10**9:  # all sets enumerate subsets
        rows = [r for r in rows if len(r[1].split()) < 60]
    want = brute(rows)
    assert len({w[2] for w in want}) < len(want)
    assert found(jaccard.jaccard_components(docs(spark, rows), block=block, limit=limit)) == want


def test_hot_copies_near_copies_and_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SALT_ROWS", 8)
    monkeypatch.setattr(jaccard, "CELLS", 1 << 10)
    monkeypatch.setattr(jaccard, "_CELL_SHIFT", np.uint64(54))
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 4)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = [(1000 + i, " ".join(base)) for i in range(150)] + [(5000 + i, " ".join(changed(rng, base, rng.randrange(1, 3)))) for i in range(120)]
    rows += [(9000 + i, " ".join(["the", "very", "common", "line", "of", "all", "texts", *(f"u{i}_{j}" for j in range(20))])) for i in range(60)]
    for limit in (None, 200):
        monkeypatch.setattr(jaccard, "BEST", 1 if limit else 3)
        assert found(jaccard.jaccard_components(docs(spark, rows), block=16, limit=limit)) == brute(rows)


def test_nulls_short_texts_and_repeated_rows(spark):
    long = "word " * 4000 + " ".join(f"l{i}" for i in range(3000))
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é É"), (8, "é É"), (None, "one"), (None, a), (None, None)]
    rows += [(10, long), (11, long + " end"), (20, a), (27, a), (27, b), (27, b), (29, b + " more"), (30, "a b c d e"), (31, "a b c d e f"), (40, a + " x y"), (41, "a\x00b c")]
    assert found(jaccard.jaccard_components(docs(spark, rows))) == brute(rows)


def test_of_nothing(spark):
    for rows in ([(1, None), (None, None)],):
        assert found(jaccard.jaccard_components(docs(spark, rows))) == brute(rows)


def test_prefixes_share_subsets():
    """Whatever the order, a pair that links has SUBSET common shingles in both prefixes, unless the sets are equal."""
    rng = random.Random(3)
    for _ in range(3000):
        n, m = rng.randrange(1, 60), rng.randrange(1, 60)
        common = rng.randrange(0, min(n, m) + 1)
        if 100 * common >= 80 * (n + m - common) and not n == m == common:
            order = list(range(n + m - common))
            rng.shuffle(order)
            x, y = sorted(order[:n]), sorted(order[n - common :])
            p, q = (x[: len(x) - int(jaccard.least(np.int64(len(x)))) + jaccard.SUBSET], y[: len(y) - int(jaccard.least(np.int64(len(y)))) + jaccard.SUBSET])
            assert len(set(p) & set(q)) >= jaccard.SUBSET


@pytest.mark.parametrize("limit", [0, 10**9])
def test_members_that_cannot_link_are_left_out(spark, monkeypatch, limit):
    """A text made of others shares rare shingles with each, but is too long to link with them: none is carried on with its bitmap."""
    kept, members = [], jaccard.members
    monkeypatch.setattr(jaccard, "members", lambda *given: kept.append(members(*given)) or kept[-1])
    rng = random.Random(5)
    parts = [[f"p{i}_{j}" for j in range(40)] for i in range(5)]
    near = [f"n{j}" for j in range(100)]
    rows = [(i, " ".join(p)) for i, p in enumerate(parts)] + [(50, " ".join(sum(parts, [])))] + [(100 + i, " ".join(changed(rng, near, 1))) for i in range(3)]
    want = brute(rows)
    assert sorted(w[2] for w in want) == [0, 1, 2, 3, 4, 50, 100, 100, 100]
    assert found(jaccard.jaccard_components(docs(spark, rows), limit=limit)) == want
    assert {r.id for r in kept[0].select("id").collect()} == {100, 101, 102}


@pytest.mark.parametrize("near", [1, 32])
def test_linked_pairs_keep_a_key_in_common(near, monkeypatch):
    """Whatever the order, the key of the first common shingles leaves a linked pair in; a group over NEAR is left whole."""
    monkeypatch.setattr(jaccard, "NEAR", near)
    rng, linked = random.Random(7), 0
    for _ in range(3000):
        n, m = rng.randrange(2, 60), rng.randrange(2, 60)
        common = rng.randrange(0, min(n, m) + 1)
        order = list(range(n + m - common))
        rng.shuffle(order)
        x, y = sorted(order[:n]), sorted(order[n - common :])
        if 100 * common >= 80 * (n + m - common) and common >= 2:
            first, second = sorted(set(x) & set(y))[:2]
            lists = np.array([n - x.index(first), m - y.index(first)])
            subsets = np.array([n - x.index(second) + 1, m - y.index(second) + 1])
            for most in (lists, subsets):
                linked += 1
                assert jaccard._partnered(np.zeros(2, np.int64), np.array([n, m]), most).all()
    assert linked > 100
    sizes = np.array([10, 100, 10, 10])
    assert jaccard._partnered(np.array([0, 0, 1, 1]), sizes, sizes).tolist() == [near == 1, near == 1, True, True]


def test_frequencies_are_small_for_the_driver(spark):
    """The counts of all cells come to the driver and go to all workers: two bytes each, in the order of the counts, small counts as they are."""
    rows = [(i, " ".join(f"w{j}" for j in range(i % 7 + 5))) for i in range(300)] + [(999, None)]
    want = np.zeros(jaccard.CELLS, np.int64)
    buf, offs = jaccard.C.text_bytes(jaccard.pa.array([t for _, t in rows]))
    np.add.at(want, (jaccard._sets(buf, offs)[1] >> jaccard._CELL_SHIFT).astype(np.int64), 1)
    cells = jaccard.frequencies(docs(spark, rows))
    assert cells.nbytes == 2 * jaccard.CELLS
    found, small = jaccard.counted(cells), want <= 256
    assert (found[small] == want[small]).all() and (abs(found - want) * 128 <= want).all() and want.max() == 300
    counts = np.unique(np.concatenate([np.arange(5000), np.random.default_rng(1).integers(0, 2**50, 5000)]))
    codes = jaccard.rounded(counts).astype(np.int64)
    assert (np.diff(codes) >= 0).all() and (np.diff(codes)[:256] > 0).all()


def test_boundary_weighs_whole_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHARE", 1)
    rng = random.Random(4)
    texts = [" ".join(f"c{rng.randrange(12)}" for _ in range(rng.choice([5, 6, 7, 9, 12, 40, 90]))) for _ in range(300)]
    df = docs(spark, list(enumerate(texts + texts[:50]))).withColumnRenamed("doc_id", "id")
    cells = spark.sparkContext.broadcast(jaccard.frequencies(df))
    sets = jaccard.C.materialise(jaccard.describe(df, cells))
    kept = {(r.n, bytes(r.digest)): np.frombuffer(r.prefix, np.uint64) for r in sets.collect()}
    lists = [(n, int(k)) for (n, _), p in kept.items() for k in jaccard._list_keys(p[: n - int(jaccard.least(np.int64(n))) + 1])]
    lengths, want, spared, most = Counter(k for _, k in lists), 0, 0, 0
    for kind in sorted({math.floor(4 * math.log2(n)) for n, _ in kept}):
        own = [n for n, _ in kept if math.floor(4 * math.log2(n)) == kind]
        spared += sum(lengths[k] + 1 for n, k in lists if n in own) - sum(math.comb(min(n, n - int(jaccard.least(np.int64(n))) + jaccard.SUBSET), 2) for n in own)
        if spared > most:
            most, want = spared, max(own)
    assert 0 < want < max(n for n, _ in kept)
    assert jaccard.boundary(sets) == want
