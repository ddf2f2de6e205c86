"""Operators for training data against brute force, libraries and planted cases."""

import base64
import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, common, components, decontaminate, exact_dedup, html_text, language_id, lm_score, minhash, quality, queries, suffix_dedup, token_counts

DOC = "doc_id long, text string, kept string"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs(spark, texts, start=0):
    """Documents with a column whose name clashes with one of the results'."""
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts, start)], DOC)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


EDGE = [None, "", "   ", "One", "one two three four", "ONE two\tthree  four", "é" * 3000, "word " * 3000, "a b c d e f g", "A b c d e f g"]


def test_bpe_equals_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    alphabets = ["ab", "aé", "abcdefgh \n", "therein", "漢字かな", "0123456789", ".,-=_*", "🙂 a"]
    texts = EDGE + ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 7, 60, 700, 5000)]
    rows = bpe.bpe_decode(bpe.bpe_encode(docs(spark, texts), PATH, public_tokenizers.PATTERN), PATH).collect()
    assert {r.doc_id: list(r.token_ids) for r in rows} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.decoded) for r in rows} == {i: (t or "").encode() for i, t in enumerate(texts)}
    got = bpe.bpe_digests(docs(spark, texts), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.bpe_digests(docs(spark, ["a"]).limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.bpe_encode(docs(spark, ["a"]).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_exact_groups(spark):
    texts = EDGE + ["A B", "a b", "Ä", "ä"] + ["hot"] * 60
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs(spark, texts), salt_rows=8).collect()}
    groups = collections.defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        groups[(t or "").translate(lower)].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.kept) for r in exact_dedup.exact_groups(twice).collect()) == [("1", False), ("1", True), ("None", False), ("None", True)]
    assert exact_dedup.exact_groups(twice.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(docs(spark, texts)).count() == len(groups)


def test_exact_dedup_of_repeated_rows_and_rows_without_an_id(spark):
    rows = [(1, "a"), (1, "A"), (3, "b"), (5, "b"), (5, "b"), (7, "c"), (7, "d"), (None, "e"), (None, "f"), (None, "f"), (None, "b"), (None, None), (9, "a" * 9)]
    out = exact_dedup.exact_dedup(spark.createDataFrame([(i, t, "x") for i, t in rows], DOC))
    assert out.columns == ["doc_id", "text", "kept"]
    got = collections.Counter((str(r.doc_id), (r.text or "").lower()) for r in out.collect())
    assert got == collections.Counter([("1", "a"), ("5", "b"), ("7", "c"), ("7", "d"), ("None", "e"), ("None", "f"), ("None", ""), ("9", "a" * 9)])


def near_by_brute_force(texts):
    sets = {i: minhash.shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("block", [4096, 16])
def test_near_groups(spark, block):
    rng, texts = random.Random(4), list(EDGE)
    for size in (2, 5, 60):
        base = prose(rng, 60).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "new%d" % rng.randrange(1000)
            texts.append(" ".join(own))
    texts += texts[-10:]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs(spark, texts), block=block).collect()}
    assert got == near_by_brute_force(dict(enumerate(texts)))
    assert minhash.near_dedup(docs(spark, texts)).count() == len({c for _, c in got.values()})


def test_near_groups_of_nothing(spark):
    assert minhash.near_groups(docs(spark, ["a"]).limit(0)).count() == 0
    rows = minhash.near_groups(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.n_shingles, r.kept) for r in rows) == [("1", "1", 2, True), ("1", "1", 2, True), ("None", "1", 2, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    random.Random(2).shuffle(edges)
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_wavelet_index():
    rng = np.random.default_rng(0)
    seq = np.append(rng.integers(1, 5, 400), 0).astype(np.int32)
    index = decontaminate.FmIndex(seq, 4)
    for n in (1, 2, 5):
        phrases = np.array([seq[i : i + n] for i in range(0, 60)], np.int32)
        lo, hi = index.search(phrases)
        for k, p in enumerate(phrases):
            want = [i for i in range(len(seq) - n) if (seq[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_contamination(spark):
    rng = random.Random(6)
    item, short = prose(rng, 14), "tiny item here"
    words = prose(rng, 40).split()
    texts = EDGE + [" ".join(words[:10]) + " " + item.upper() + " " + " ".join(words[10:]), " ".join(item.split()[:9]), "x Tiny, ITEM here. " * 3, item + " " + item]
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (4, "..."), (2, short)], "item_id long, text string")
    for size in (32 << 20, 16):
        got = {r.doc_id: r for r in decontaminate.contamination(docs(spark, texts), bench, bench_bytes=size).collect()}
        n = len(EDGE)
        assert [(s["first"], s["last"]) for s in got[n].spans] == [(10, 24)] and got[n]["items"] == ["1"]
        assert not got[n + 1].spans and got[n + 2]["items"] == ["2"] and [(s["first"], s["last"]) for s in got[n + 3].spans] == [(0, 28)]
        assert [(s["first"], s["last"]) for s in got[n + 2].spans] == [(1, 4), (5, 8), (9, 12)]
    assert decontaminate.contamination(docs(spark, texts), bench.limit(0)).filter("size(spans) > 0").count() == 0


def test_language(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = spark.createDataFrame([(9001, None, None, None), (9002, "", "en", "src1"), (9003, "12 34 !!", "en", "src1")], table.schema)
    got = {r.doc_id: r for r in language_id.identify(table.unionByName(extra)).collect()}
    rows = table.collect()
    assert sum(got[r.doc_id].language == r.lang for r in rows) >= 0.99 * len(rows) and all(got[r.doc_id].accepted for r in rows)
    assert not any(got[i].accepted for i in (9001, 9002, 9003))
    assert language_id.identify(table.limit(0)).count() == 0


def test_language_without_declarations(spark, sf):
    """The declaration is withheld, or wrong, and not the label that is checked."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    for every, told in ((2, F.lit(None).cast("string")), (5, F.when(F.col("lang") == "en", "fr").otherwise("en"))):
        hidden = F.col("doc_id") % every == 0
        got = {r.doc_id: r for r in language_id.identify(table.withColumn("lang", F.when(hidden, told).otherwise(F.col("lang")))).collect()}
        rows = [r for r in table.filter(hidden).collect() if len(r.text.split()) >= 20]
        assert sum(got[r.doc_id].text_language == r.lang for r in rows) >= 0.95 * len(rows)
        assert sum(got[r.doc_id].language == r.lang for r in rows) >= 0.95 * len(rows)


def test_language_of_pages(spark, sf):
    got = queries.op3_language_id_pages(spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    told = [(r.language, pages[r.page_id].split('lang="')[1][:2]) for r in got if 'lang="' in pages[r.page_id]]
    assert len(got) == len(pages) and told and sum(a == b for a, b in told) >= 0.98 * len(told)


def test_declared_codes_are_whole(spark):
    codes = ["fil", "fi", "EN-us", "pt_BR", " de ", "x", "", None, "12"]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select(language_id.language_code(F.col("c"))).collect()
    assert [r[0] for r in got] == ["fil", "fi", "en", "pt", "de", None, None, None, None]
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(300)), "fil", "s") for i in range(20)] + [(50 + i, "".join(rng.choice("wxyz ") for _ in range(300)), "fi", "s") for i in range(20)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.language == ("fil" if r.doc_id < 50 else "fi") for r in got)


CLASHES = ["_drop", "_hit", "_out", "_sha", "_key", "_salt", "_n", "_id", "_text", "spans", "items", "n_words", "id", "kept", "words", "n_shingles", "lang", "source"]


def test_stages_judge_rows_and_take_any_column_names(spark):
    """Null ids, ids of several texts, repeated rows and clashing names."""
    rng = random.Random(30)
    item = prose(rng, 14)
    clean, leak, other = prose(rng, 40), prose(rng, 20) + " " + item, prose(rng, 40)
    rows = [(None, clean), (None, leak), (7, clean + " more"), (7, leak + " x"), (7, other), (8, "12 .. 34"), (8, other + " y"), (9, None), (10, ""), (11, other), (11, other)]
    wide = [(i, t, *("fr" if c == "lang" else "s" for c in CLASHES)) for i, t in rows]
    table = spark.createDataFrame(wide, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")

    def left(out):
        assert out.columns == table.columns
        return collections.Counter((r.doc_id, r.text) for r in out.collect())

    every = collections.Counter(rows)
    assert left(decontaminate.drop_contaminated(table, bench)) == every - collections.Counter({(None, leak): 1, (7, leak + " x"): 1})
    assert left(language_id.keep_identified(table)) == every - collections.Counter({(8, "12 .. 34"): 1, (9, None): 1, (10, ""): 1})
    assert left(exact_dedup.exact_dedup(table)) == every - collections.Counter({(7, other): 1, (11, other): 1, (9, None): 1})
    alone = table.filter("doc_id <> 7 and text <> '12 .. 34' or doc_id is null or text is null")
    assert left_of_near(minhash.near_dedup(alone)) == {(None, clean), (None, leak), (8, other + " y"), (9, None), (10, "")}
    for stage in (lambda t: decontaminate.drop_contaminated(t, bench), language_id.keep_identified, exact_dedup.exact_dedup, minhash.near_dedup):
        assert stage(table.limit(0)).count() == 0


def left_of_near(out):
    return {(r.doc_id, r.text) for r in out.collect()}


def test_salted_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(common, "SALT_ROWS", 8)
    left = spark.createDataFrame([(i, k) for i, k in enumerate([1] * 50 + [2] * 9 + [3] * 3 + [None] * 30 + [4])], "i int, k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, "e"), (None, "n")], "k int, v string")
    for how in ("inner", "left"):
        for counts in (None, left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))):
            got = common.salted_join(left, right, "k", how, counts).select("i", "k", "v").collect()
            assert sorted(map(str, got)) == sorted(map(str, left.join(right, "k", how).select("i", "k", "v").collect()))


def test_rare_languages_have_a_table_and_stay(spark):
    rng = random.Random(9)
    greek = ["".join(rng.choice("αβγδεζηθ ") for _ in range(600)) for _ in range(3)]
    rows = [(i, prose(rng, 40), "en", "s") for i in range(600)] + [(600 + i, "hot text " * 9, "fr", "s") for i in range(600)]
    rows += [(2000 + i, t, "el", "s") for i, t in enumerate(greek)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language_id.fit(table, "text", "lang", fit_rows=40)[0] == ["el", "en", "fr"]
    got = {r.doc_id: r for r in language_id.identify(table, fit_rows=40).collect()}
    assert all(got[i].accepted and got[i].language == "el" for i in range(2000, 2003))
    assert all(r.accepted for r in got.values())


def test_texts_of_a_language_without_a_table_are_not_rejected(spark, monkeypatch):
    rng, fit = random.Random(9), language_id.fit
    greek = "".join(rng.choice("αβγδεζηθ ") for _ in range(600))
    table = spark.createDataFrame([(100 + i, prose(rng, 60), "en", "s") for i in range(600)] + [(90, greek, "el", "s"), (91, greek, None, "s")], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(language_id, "fit", lambda df, *a: fit(df.filter("declared = 'en'"), *a))
    got = {r.doc_id: r.accepted for r in language_id.identify(table).collect()}
    assert got[90] and not got[91]


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op4_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(r.quality, got[r.doc_id]) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out and 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for _, g in held)
    assert sum(y == g.predicted for y, g in held) >= 0.95 * len(held)
    scored = quality.quality_scores(docs(spark, EDGE), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert len(scored) == len(EDGE) and all(0 <= r.score <= 1 for r in scored)


def test_repeats_long_texts_and_empty_tables(spark):
    """Language, quality and token counts: one row for each row, equal for equal rows."""
    rng = random.Random(40)
    texts = [prose(rng, 30), prose(rng, 30), None, "", "word " * 60000, "x" * 200000]
    rows = [(i, t, "en" if i % 2 else "fr", "s", "x") for i, t in enumerate(texts)] * 2 + [(None, texts[0], None, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    pieces = token_counts.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for run in (language_id.identify, lambda t: quality.quality_scores(t, labels), lambda t: token_counts.token_counts(t, pieces)):
        got = run(table).collect()
        assert len(got) == len(rows)
        for i in range(len(texts)):
            assert len({tuple(r) for r in got if r.doc_id == i}) == 1
        assert run(table.limit(0)).count() == 0
    assert quality.quality_scores(table, labels.limit(0)).count() == len(rows)


def lm_by_brute_force(texts):
    """Each text by the counts of all others: (scored, backed off, sum)."""
    split = [(t or "").encode().lower().split() for t in texts]
    pairs, words = collections.Counter(), collections.Counter()
    for w in split:
        pairs.update(zip(w, w[1:], strict=False))
        words.update(w)
    out, total = [], sum(words.values())
    for w in split:
        own, single, score, back = collections.Counter(zip(w, w[1:], strict=False)), collections.Counter(w), 0.0, 0
        for v, x in zip(w, w[1:], strict=False):
            if pairs[v, x] > own[v, x]:
                score += math.log((pairs[v, x] - own[v, x]) / (words[v] - single[v]))
            else:
                back, score = back + 1, score + math.log(0.4 * max(words[x] - single[x], 0.5) / max(1, total - len(w)))
        out.append((max(0, len(w) - 1), back, pytest.approx(score, abs=1e-4)))
    return out


@pytest.mark.parametrize("blocks", [1, 7])
def test_lm_scores(spark, blocks):
    rng = random.Random(8)
    texts = EDGE + [prose(rng, 30) for _ in range(20)] * 2 + [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(60)) for _ in range(9)] + [prose(rng, 40) for _ in range(5)]
    got = {r.doc_id: r for r in lm_score.self_scores(docs(spark, texts).repartition(blocks)).collect()}
    want = lm_by_brute_force(texts)
    assert [(got[i].n_scored, got[i].n_backed_off, got[i].log_score) for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 100
    small = spark.createDataFrame([(1, "a b zz")], "doc_id long, text string")
    corpus = spark.createDataFrame([("a b a c",)], "text string")
    back = lm_score.score_against(small, corpus).first()
    assert back.log_score == pytest.approx(math.log(1 / 2) + math.log(0.4 * 0.5 / 4), abs=1e-5)
    assert lm_score.self_scores(small.limit(0)).count() == 0


def test_lm_scores_of_equal_and_falling_ids(spark):
    texts = [prose(random.Random(i), 12) for i in range(10)]
    table = docs(spark, texts).coalesce(1)
    twice = lm_score.self_scores(table.union(table)).collect()
    want = lm_by_brute_force(texts + texts)
    assert all((r.n_scored, r.n_backed_off, r.log_score) == want[r.doc_id] and r.n_backed_off == 0 for r in twice) and len(twice) == 20
    once = {r.doc_id: (r.n_scored, r.log_score) for r in lm_score.self_scores(table).collect()}
    falling = [spark.createDataFrame([(i, texts[i], "x") for i in ids], DOC).coalesce(1) for ids in ((9, 8), (7, 6), (5, 4), (3, 2), (1, 0))]
    for t in falling[1:]:
        falling[0] = falling[0].union(t)
    assert {r.doc_id: (r.n_scored, r.log_score) for r in lm_score.self_scores(falling[0]).collect()} == once


def test_main_text():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header>top</header><nav><ul><li><a href="/">menu</a></ul></nav>'
        '<div class="cookie-notice">we use</div><main><article><header><h1>A &amp; B</h1></header><p>one  <i>two</i>\nthree<p>four<script>var t="</p>"</script>'
        '<aside>side</aside><div id="comments"><p>reader</p></div></article></main><form>f<input></form><footer>&copy; end</footer>'
    )
    assert html_text.main_text(page) == "A & B\none two three\nfour"
    assert html_text.main_text("<body><div>short</div><section><p>" + "long text " * 9 + "</p><p>more</p></section><footer>x</footer></body>") == ("long text " * 9).strip() + "\nmore"
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "plain &lt; text", "<p class='ad'>buy<p>good")] == ["", "", "", "plain < text", "good"]


def test_main_text_without_an_article_is_all_its_runs():
    assert html_text.main_text("<div><p>A</p><ul><li>B</li></ul><p>C</p></div>") == "A\nB\nC"
    one, two, three = ("%s sentence of the text. " % n * 8 for n in ("first", "second", "third"))
    links = "<ul>" + "<li><a href='/x'>Some other page of this site</a>" * 9 + "</ul>"
    page = f"<body><div>{links}</div><div><h1>Title</h1></div><section><p>{one}</p></section><section><p>{two}</p><table><tr><td>1<td>2</table></section>{links}<div><dl><dt>a<dd>b</dl><p>{three} <a href='/y'>more</a></p></div><div>(c) 2020</div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", one.strip(), two.strip(), "1", "2", "a", "b", three.strip() + " more"])


def test_main_text_is_decided_by_weights_not_by_elements_alone():
    para = ["%s paragraph of the article that goes on for a while. " % n * 5 for n in ("first", "second", "third")]
    want = "\n".join(["Title", *(x.strip() for x in para)])
    body = "".join(f"<section><p>{x}</p></section>" for x in para)
    assert html_text.main_text(f"<body><section><h1>Title</h1></section>{body}</body>") == want
    # an article of the headline alone doesn't lose the body beside it, and a full one gains no teaser
    assert html_text.main_text(f"<article><h1>Title</h1></article><div>{body}</div>") == want
    assert html_text.main_text(f"<article><h1>Title</h1>{body}</article><div><p>Read our other page on this.</p></div>") == want
    # names that only hold a mark remove nothing, names made of marks do
    for name in ("social-science", "alert-study", "has-sidebar", "ad-free"):
        assert html_text.main_text(f"<article><h1>Title</h1><div class='{name}'>{body}</div></article>") == want
    for name in ("social-share", "ad-slot-3", "commentList", "site-footer", "x cookie_notice"):
        assert html_text.main_text(f"<article><h1>Title</h1>{body}<div class='{name}'><p>{para[0]}</p></div></article>") == want
    # an advert without an end hides its own text only
    assert html_text.main_text(f"<div class='ad'>buy<article><h1>Title</h1>{body}</article>") == want
    assert html_text.main_text(f"<div class='ad'>buy<h1>Title</h1>{body}") == want


def test_main_text_of_a_table(spark):
    pages = [(1, "u", None, "x"), (1, "u", None, "x"), (2, "v", "<p>a &amp; b</p>", "x"), (None, None, "<p>" + "long " * 50000 + "</p>", "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), len(r.text)) for r in html_text.extract_text(table).collect())
    assert got == [("1", 0), ("1", 0), ("2", 5), ("None", 249999)]
    assert html_text.extract_text(table.limit(0)).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(5)
    shared = prose(rng, 70)
    texts = EDGE + [prose(rng, 30) + " " + shared + " " + prose(rng, 90), prose(rng, 100) + " " + shared, prose(rng, 300), prose(rng, 20) + " " + " ".join(shared.split()[:45]) + " " + prose(rng, 20)]
    got = {r.doc_id: r for r in suffix_dedup.repeated_passages(docs(spark, texts)).collect()}
    n = len(EDGE)
    assert [tuple(s) for s in got[n].spans] == [(30, 100)] and [tuple(s) for s in got[n + 1].spans] == [(100, 170)]
    assert not got[n + 2].spans and not got[n + 3].spans and got[7].n_repeated == 3000
    assert suffix_dedup.repeated_passages(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("large", [2048, 20, 1])
def test_repeated_passages_of_a_hot_template_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE_ROWS", large)
    rng = random.Random(12)
    template, more = prose(rng, 45), [prose(rng, 10) for _ in range(12)]
    texts = [prose(rng, 30) + " " + template + " " + prose(rng, 30) for _ in range(150)]
    for k, m in enumerate(more):
        before, after = (5 + k % 6, 0) if k % 3 == 0 else (0, 5 + k % 6) if k % 3 == 1 else (3, 3)
        own = m.split()
        for _ in range(2):
            texts.append(" ".join([prose(rng, 30), *own[len(own) - before :], template, *own[:after], prose(rng, 30)]))
    texts += [prose(rng, 20) + " " + " ".join(texts[3].split()[10:90]), "x y z " * 60, *EDGE]
    rng.shuffle(texts)
    words = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    seen = collections.Counter(tuple(w[s : s + 50]) for w in words.values() for s in range(len(w) - 49))
    want = {}
    for i, w in words.items():
        hit = {x for s in range(len(w) - 49) if seen[tuple(w[s : s + 50])] > 1 for x in range(s, s + 50)}
        want[i] = len(hit)
    got = {r.doc_id: r.n_repeated for r in suffix_dedup.repeated_passages(docs(spark, texts)).collect()}
    assert got == want


def repeated_by_brute_force(texts):
    words = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    seen = collections.Counter(tuple(w[s : s + 50]) for w in words.values() for s in range(len(w) - 49))
    return {i: len({x for s in range(len(w) - 49) if seen[tuple(w[s : s + 50])] > 1 for x in range(s, s + 50)}) for i, w in words.items()}


@pytest.mark.parametrize("large", [2048, 1])
def test_repeated_passages_of_overlapping_cuts_and_periods_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE_ROWS", large)
    rng, texts = random.Random(21), list(EDGE)
    base = prose(rng, 300).split()
    for _ in range(150):
        at = rng.randrange(240)
        texts.append(" ".join([prose(rng, rng.randrange(20)), *base[at : at + rng.randrange(50, 71)], prose(rng, rng.randrange(20))]))
    for n in (2, 7, 30, 45, 60):
        texts.append(prose(rng, 10) + " " + (prose(rng, n) + " ") * 3 + prose(rng, 40))
    for near in range(40):
        own = base[100:200]
        own[50] = "odd%d" % near
        texts.append(" ".join(own))
    got = {r.doc_id: r.n_repeated for r in suffix_dedup.repeated_passages(docs(spark, texts)).collect()}
    assert got == repeated_by_brute_force(texts)


@pytest.mark.parametrize("bound", [1, 3, 10**6])
def test_group_sizes_are_the_same_for_hot_and_other_keys(spark, monkeypatch, bound):
    monkeypatch.setattr(suffix_dedup, "HOT_KEYS", bound)
    keys = [7] * 20 + [8, 9, 9, 10, 10, 10, -1]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key long")
    got = suffix_dedup.sized(rows).select("id", "n").collect()
    assert sorted(map(tuple, got)) == [(i, keys.count(k)) for i, k in enumerate(keys) if keys.count(k) > 1]


def test_token_counts(spark):
    pieces = token_counts.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    known, most = set(pieces), max(map(len, pieces))

    def greedy(word):
        word, i, n = token_counts.MARK + word, 0, 0
        while i < len(word):
            size = next((k for k in range(min(most, len(word) - i), 0, -1) if word[i : i + k] in known), 0)
            n, i = n + (1 if size else len(word[i].encode())), i + max(1, size)
        return n

    rng = random.Random(3)
    texts = EDGE + ["Theretion zzqx 日本語テキスト ҖҖabc ▁▁a 🙂a🙂", prose(rng, 400), "".join(rng.choice("theringaou") for _ in range(20000))]
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, texts), pieces).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_tokens) == (len((t or "").split()), sum(map(greedy, (t or "").split())))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_pipeline(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert set(source.columns) < set(out.columns)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = {}
    for r in source.orderBy("doc_id").collect():
        rows[r.text.translate(lower)] = (r.doc_id, r.text)
    rows = dict(rows.values())
    kept = {i for i, (_, c) in near_by_brute_force(rows).items() if i == c}
    hit = decontaminate.contamination_report(source, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").select("doc_id").collect()
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept - {r.doc_id for r in hit}
    assert out.filter(F.size("token_ids") == 0).count() == 0


def test_pipeline_decodes_what_it_encoded(spark, sf):
    texts = [t for t in EDGE if t is not None] + ["漢字かな 🙂", None]
    rows = corpus_pipeline.encode(spark, docs(spark, texts), sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.text == texts[r.doc_id] and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.token_ids)).encode()).hexdigest()
