"""Benchmark decontamination by an FM-index of each training shard.

A shard is a bounded run of rows of one partition. What can't be part of an occurrence isn't indexed. Its words become symbols of the benchmark's vocabulary;
runs of benchmark words that are long enough to hold a test phrase are indexed: suffix array, BWT, wavelet
matrix for ranks, and the suffix positions at every SAMPLED-th place. All test phrases of one length are
searched backwards at once, their occurrences are located by walking to sampled positions, and the spans of
each row are merged. Texts aren't shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Words of a test phrase; every how many places a suffix position is kept.
WINDOW, SAMPLED = 10, 8
#: Bytes of benchmark texts sent to the executors at once; a larger benchmark takes several passes.
BENCH_BYTES = 32 << 20

def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = C.text_bytes(pa.array(texts, pa.string()))
    folded = C.LOWER[buf]
    starts, ends, first = C.word_spans(folded, offs, C.ALNUM)
    return C.word_hashes(folded, starts, ends), first


class Phrases:
    """The distinct test phrases of a block of benchmark items, as symbols 1.. of its vocabulary."""

    def __init__(self, items: list[tuple]) -> None:
        words, first = words_of([t for _, t in items])
        self.vocabulary, symbol = np.unique(words, return_inverse=True)
        symbol = symbol.astype(np.int32) + 1
        by_length: dict[int, dict[bytes, set]] = {}
        for k, (item, _) in enumerate(items):
            own = symbol[first[k] : first[k + 1]]
            n = min(WINDOW, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(own[i : i + n].tobytes(), set()).add(str(item))
        self.groups = [(n, np.frombuffer(b"".join(found), np.int32).reshape(-1, n), [sorted(x) for x in found.values()]) for n, found in by_length.items()]
        self.least = min(by_length, default=0)


class WaveletMatrix:
    """Ranks of symbols in a sequence, bit by bit from the highest."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start, at = np.zeros_like(at), at
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - start


class FmIndex:
    """An index of a sequence of symbols >= 1, with 0 as its last: the runs of benchmark words of a shard, not all of its words."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        suffixes = self.sort(seq)
        self.bwt = seq[suffixes - 1]
        self.less = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=symbols + 1), out=self.less[1:])
        self.matrix = WaveletMatrix(self.bwt, max(1, int(symbols).bit_length()))
        kept = suffixes % SAMPLED == 0
        self.before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.places = kept, suffixes[kept]

    @staticmethod
    def sort(seq: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        rank, step, n = seq.astype(np.int64), 1, len(seq)
        while True:
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            key = rank * (n + int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if rank[order[-1]] == n - 1:
                return order
            step *= 2

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (rows of symbols)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for col in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, col]
            lo, hi = self.less[c] + self.matrix.rank(c, lo), self.less[c] + self.matrix.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of these rows of the suffix array."""
        out, live, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            done = self.kept[rows]
            out[live[done]] = self.places[self.before[rows[done]]] + steps
            live, rows, steps = live[~done], rows[~done], steps + 1
            c = self.bwt[rows]
            rows = self.less[c] + self.matrix.rank(c, rows)
        return out


def find_in_shard(words: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Word places that are hit (as a mask), and the items of each row."""
    n = len(first) - 1
    hit, items = np.zeros(len(words) + 1, np.int32), [set() for _ in range(n)]
    if not len(words) or not phrases.groups:
        return hit[:-1] > 0, first, items
    row = np.repeat(np.arange(n), np.diff(first))
    at = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
    known = np.flatnonzero(phrases.vocabulary[at] == words)
    if not len(known):
        return hit[:-1] > 0, first, items
    # runs of neighbouring benchmark words of one row
    new = np.ones(len(known), bool)
    new[1:] = (known[1:] != known[:-1] + 1) | (row[known[1:]] != row[known[:-1]])
    run = np.cumsum(new) - 1
    keep = (np.bincount(run) >= phrases.least)[run]
    known, run = known[keep], run[keep]
    if not len(known):
        return hit[:-1] > 0, first, items
    other = len(phrases.vocabulary) + 1
    edge = np.flatnonzero(np.append(run[1:] != run[:-1], True))
    seq = np.insert(at[known].astype(np.int32) + 1, edge + 1, other)
    place = np.insert(known, edge + 1, -1)
    index = FmIndex(np.append(seq, 0).astype(np.int32), other)
    for length, rows, owners in phrases.groups:
        lo, hi = index.search(rows)
        for lot in np.array_split(np.flatnonzero(hi > lo), max(1, int((hi - lo).sum()) >> 20)):
            count = hi[lot] - lo[lot]
            which = np.repeat(lot, count)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            word = place[index.locate(lo[which] + inner)]
            np.add.at(hit, word, 1)
            np.add.at(hit, word + length, -1)
            pairs = np.unique(np.column_stack([row[word], which]), axis=0)
            for r, w in pairs.tolist():
                items[r].update(owners[w])
    return np.cumsum(hit[:-1]) > 0, first, items


def _pass(df: DataFrame, text_col: str, out: tuple[str, str, str], held, first_pass: bool) -> DataFrame:
    """df with n_words, spans and items (named by out), or with what one more block of items (a broadcast) adds to them."""
    names = [c for c in df.columns if c not in out]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        phrases = Phrases(held.value)
        for batch in batches:
            buf, offs = C.text_bytes(batch.column(text_col))
            for lo, hi in C.pieces(offs):
                part, own = batch.slice(lo, hi - lo), offs[lo : hi + 1]
                folded = C.LOWER[buf[own[0] : own[-1]]]
                starts, ends, first = C.word_spans(folded, own - own[0], C.ALNUM)
                mask, first, found = find_in_shard(C.word_hashes(folded, starts, ends), first, phrases)
                n_words = np.diff(first)
                if not first_pass:
                    for k, (spans, have) in enumerate(zip(part.column(out[1]).to_pylist(), part.column(out[2]).to_pylist(), strict=True)):
                        found[k].update(have)
                        for s in spans:
                            mask[first[k] + s["first"] : first[k] + s["last"]] = True
                spans = []
                for k in range(hi - lo):
                    m = np.zeros(n_words[k] + 2, np.int8)
                    m[1:-1] = mask[first[k] : first[k + 1]]
                    d = np.diff(m)
                    spans.append([{"first": a, "last": b} for a, b in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(n_words), pa.array(spans, kind), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=[*names, *out]
                )

    kinds = ("long", "array<struct<first:int,last:int>>", "array<string>")
    schema = df.select(*(F.col(f"`{n}`") for n in names), *(F.lit(None).cast(k).alias(n) for n, k in zip(out, kinds, strict=True))).schema
    return df.mapInArrow(run, schema)


def with_contamination(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", bench_bytes: int = BENCH_BYTES, out: tuple[str, str, str] = ("n_words", "spans", "items")
) -> DataFrame:
    """df with its words' count, merged spans of hit words, [first, last), and the items found; rows aren't shuffled.

    Null texts have no words; items without words or without an id hit nothing. Repeated rows give
    repeated rows, repeated items count once. Columns named like out are replaced. A benchmark over bench_bytes is
    searched in blocks of items; the table is written between two blocks, and a block's items leave the executors.
    """
    rows = df
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).dropna().distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // bench_bytes))
    for b in range(blocks):
        block = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        held = df.sparkSession.sparkContext.broadcast([tuple(x) for x in block.collect()])
        rows = _pass(rows, text_col, out, held, b == 0)
        if b + 1 < blocks:
            rows = C.materialise(rows)
            held.unpersist()
    return rows


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", bench_bytes: int = BENCH_BYTES) -> DataFrame:
    """(id, n_words, spans, items) per row of df, by with_contamination()."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_contamination(rows, benchmark, "text", item_col, item_text, bench_bytes)
    return found.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def contamination_report(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and digests of contamination(), per document."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return contamination(df, benchmark).select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df none of whose words is hit, each judged by its own text, whatever its id; null texts stay.

    Repeated rows share their fate. Any column names may stand beside; an empty table gives an empty table.
    """
    out = tuple(C.private(df, n) for n in ("n_words", "spans", "items"))
    return with_contamination(df, benchmark, text_col, out=out).filter(F.size(out[1]) == 0).drop(*out)


#: Windows are joined as strings of their words, one space between two.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS phrase
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
