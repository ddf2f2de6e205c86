"""Stupid-backoff scores: counts of n-grams partitioned by hash, joined to the documents' n-grams, summed.

A document's n-grams are exploded within a block of documents of one task: for each hash partition one row
with the block's distinct words and pairs of words, and how often each occurs. A partition's task adds up its
part of the count table from all blocks, joins it to the same n-grams, and sends the counts back. A block's task
then scores its documents, each by the counts of all other documents: what a document adds to a count is
taken off, so a pair that no other document has falls back to its second word. Rows are packed, so an n-gram takes a few
bytes, and a frequent one is one entry of a block, however often it occurs. A block is known by its
partition and its number there; rows are sorted within a partition, so a task that runs again makes the
same blocks.

score_against() scores one table by the counts of another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Factor of a score that falls back to the single word, occurrences that an unknown word counts as; words and documents of a block at most.
ALPHA, UNKNOWN, BLOCK_WORDS, BLOCK_DOCS = 0.4, 0.5, 1 << 20, 1 << 15
#: Bytes of text for each hash partition, and the least number of partitions.
PART_BYTES, LEAST_PARTS = 32 << 20, 64

#: Rows to a partition have the steps from key to key and n; one row of a block has its ids, lengths, distinct words and its words as places among those.
PACKED = "part int, block long, keys binary, n binary, ids binary, sizes binary, places binary"
KINDS = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
NAMES = PACKED.replace(",", "").split()[::2]


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, lowest first, as many as the largest needs; planes of small numbers compress well."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unsqueeze(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T
    return out.view("<u8").ravel()


def _rows(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
    return [pa.array(c, t) for c, t in zip(cols, KINDS, strict=True)]


def _pairs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of neighbouring words of documents of these sizes, which are odd, and the place of each pair's first word."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first = np.flatnonzero(doc[1:] == doc[:-1])
    return C.run_hashes(words, 2)[first] | np.uint64(1), first


def pack(rows: DataFrame, parts: int) -> DataFrame:
    """(id, text) as packed n-grams: even keys are words, odd keys pairs of words."""

    def emit(number, words, sizes, ids):
        # mix is one to one, so blocks have different names, and they are dealt evenly
        block = int(C.signed(C.mix(np.array([TaskContext.get().partitionId() << 32 | number], np.uint64)))[0])
        one, place, n_one = np.unique(words, return_inverse=True, return_counts=True)
        two, n_two = np.unique(_pairs_of(words, sizes)[0], return_counts=True)
        keys, n = np.concatenate([one, two]), np.concatenate([n_one, n_two])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        # the high bits of a key say its partition, so that partitions are runs of the sorted keys
        cut = np.append(np.searchsorted(keys, np.array([p * 2**64 // parts for p in range(parts)], np.uint64)), len(keys))
        out = [(block % parts, block, squeeze(np.diff(one, prepend=np.uint64(0))), b"", ids.tobytes(), squeeze(sizes), squeeze(place))]
        for p in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(cut[p], cut[p + 1])
            out.append((p, block, squeeze(np.diff(keys[own], prepend=np.uint64(0))), squeeze(n[own]), b"", b"", b""))
        return pa.RecordBatch.from_arrays(_rows(out), names=NAMES)

    def run(batches):
        held, n_words, n_docs, number = [], 0, 0, 0
        for batch in batches:
            buf, offs = C.text_bytes(batch.column("text"))
            for lo, hi in C.pieces(offs):
                starts, ends, first = C.word_spans(buf, offs[lo : hi + 1], C.NOT_SPACE)
                held.append((C.word_hashes(buf, starts, ends) & ~np.uint64(1), np.diff(first), batch.column("id").slice(lo, hi - lo).to_numpy()))
                n_words, n_docs = n_words + len(starts), n_docs + hi - lo
                if n_words >= BLOCK_WORDS or n_docs >= BLOCK_DOCS:
                    yield emit(number, *(np.concatenate([h[k] for h in held]) for k in range(3)))
                    held, n_words, n_docs, number = [], 0, 0, number + 1
        if held:
            yield emit(number, *(np.concatenate([h[k] for h in held]) for k in range(3)))

    return rows.sortWithinPartitions("id", "text").mapInArrow(run, PACKED)


def _join_counts(table: pa.Table) -> pa.Table:
    """One partition: its counts over all blocks, sent back to each block in the order of its keys."""
    lists = [table.column(c).to_pylist() for c in NAMES]
    rows = [r for r in zip(*lists, strict=True) if r[3]]
    out = [r for r in zip(*lists, strict=True) if not r[3]]
    if rows:
        keys = [np.cumsum(unsqueeze(r[2]), dtype=np.uint64) for r in rows]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        # sums of whole numbers below 2**53 are exact
        total = np.bincount(which, weights=np.concatenate([unsqueeze(r[3]) for r in rows])).astype(np.uint64)
        at = 0
        for (part, block, *_), own in zip(rows, keys, strict=True):
            out.append((part, block, b"", squeeze(total[which[at : at + len(own)]]), b"", b"", b""))
            at += len(own)
    return pa.Table.from_arrays(_rows(out), names=NAMES)


def _others(total: np.ndarray, doc: np.ndarray, which: np.ndarray) -> np.ndarray:
    """For each occurrence of an n-gram (which) in a document: its count in all other documents."""
    _, own, times = np.unique(doc.astype(np.uint64) << np.uint64(32) | which.astype(np.uint64), return_inverse=True, return_counts=True)
    return total[which] - times[own]


def _score_block(n_words: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in NAMES), strict=True), key=lambda r: (bool(r[3]), r[0]))
        [(_, _, one, _, ids, sizes, place), *counted] = rows
        one, ids = np.cumsum(unsqueeze(one), dtype=np.uint64), np.frombuffer(ids, np.int64)
        sizes, place = unsqueeze(sizes).astype(np.int64), unsqueeze(place).astype(np.int64)
        count = np.concatenate([np.zeros(0), *(unsqueeze(r[3]).astype(float) for r in counted)])
        pairs, first = _pairs_of(one[place], sizes)
        two, which = np.unique(pairs, return_inverse=True)
        keys = np.sort(np.concatenate([one, two]))
        count_one, count_two = count[np.searchsorted(keys, one)], count[np.searchsorted(keys, two)]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        single = _others(count_one, doc, place)
        double, own = _others(count_two, doc[first], which), doc[first]
        seen = double > 0
        known = np.log(np.where(seen, double, 1) / np.where(seen, single[first], 1))
        back = np.log(ALPHA * np.maximum(single[first + 1], UNKNOWN) / np.maximum(n_words - sizes[own], 1))
        score = np.bincount(own, weights=np.where(seen, known, back), minlength=len(ids))
        fell = np.bincount(own, weights=~seen, minlength=len(ids)).astype(np.int64)
        return pa.table({"id": ids, "n_scored": np.maximum(sizes - 1, 0), "n_backed_off": fell, "log_score": score})

    return run


def self_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_scored, n_backed_off, log_score, mean_log_score) per row: each word after the first given the one before it.

    Words are `[^\\x20\\x09-\\x0D]+`, as they stand but for A-Z, which are lower-cased. A row is scored by the counts
    c of all other rows of df: a pair (v, w) has c(v w) / c(v) if another row has it, else ALPHA * c(w) / N, where a
    word of no other row counts UNKNOWN. Null texts and texts of one word have nothing scored, a sum of 0 and no
    mean. Repeated rows are others of each other. Rows without an id are left out of scores and counts.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    size, n_words = rows.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    packed = pack(rows, max(LEAST_PARTS, (size or 0) // PART_BYTES))
    counted = packed.groupBy("part").applyInArrow(_join_counts, PACKED)
    scores = counted.groupBy("block").applyInArrow(_score_block(n_words or 0), "id long, n_scored long, n_backed_off long, log_score double")
    return scores.select(
        F.col("id").alias(id_col), "n_scored", "n_backed_off", F.round("log_score", 6).alias("log_score"),
        F.when(F.col("n_scored") > 0, F.round(F.col("log_score") / F.col("n_scored"), 6)).alias("mean_log_score"),
    )


def ngram_counts(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(w, c) and (v, w, c): the words and the pairs of neighbouring words of a table; null texts have none."""
    words = df.select(_words(text_col).alias("ws"))
    ones = words.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return ones, words.select(F.inline(_pairs("ws"))).groupBy("v", "w").agg(F.count(F.lit(1)).alias("c"))


def _words(text_col: str):
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _pairs(ws: str):
    before, after = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.size(ws))
    return F.zip_with(before, after, lambda v, w: F.struct(v.alias("v"), w.alias("w")))


def score_against(df: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(id, n_scored, log_score) per id of df by the counts of corpus, as joins.

    A pair (v, w) has the score c(v w) / c(v) if it is in the corpus, else alpha * c(w) / N; a word that isn't
    there either counts UNKNOWN. Null texts and texts of one word have nothing scored; rows of one id are added up.
    """
    ones, twos = ngram_counts(corpus, text_col)
    total = ones.agg(F.sum("c").alias("total"))
    starts = ones.select(F.col("w").alias("v"), F.col("c").alias("cv"))
    grams = df.select(id_col, _words(text_col).alias("ws")).select(id_col, F.inline(_pairs("ws")))
    grams = grams.groupBy(id_col, "v", "w").agg(F.count(F.lit(1)).alias("times"))
    joined = grams.join(twos.withColumnRenamed("c", "cvw"), ["v", "w"], "left").join(starts, "v", "left").join(ones, "w", "left").crossJoin(F.broadcast(total))
    log = F.when(F.col("cvw").isNotNull(), F.log(F.col("cvw") / F.col("cv"))).otherwise(F.log(alpha * F.coalesce("c", F.lit(UNKNOWN)) / F.col("total")))
    scored = joined.groupBy(id_col).agg(F.sum("times").alias("n_scored"), F.round(F.sum(F.col("times") * log), 6).alias("log_score"))
    return df.select(id_col).distinct().join(scored, id_col, "left").select(id_col, F.coalesce("n_scored", F.lit(0)).alias("n_scored"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
