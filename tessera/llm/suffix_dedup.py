"""Repeated passages by sparse suffix arrays.

Suffixes are kept at minimiser positions only: of each 43 neighbouring runs of 8 words the one of the
smallest hash, so that any two equal passages of 50 words keep the same suffixes. A passage of 50 words
reaches 21 words beyond its anchor's run on one side at least; so each suffix is grouped twice, by the
29 words from its anchor on and by the 29 words up to its anchor's end, and only groups of two and more
fetch their passages: the runs of 50 words that hold the anchor and reach as far to the group's side, as
hashes of their whole words. A passage that another suffix of the group has is repeated, so whatever the
others of a group have in common, no pair is missed. Large groups, of which there are less than HOT_KEYS,
aren't brought together: their passages are grouped by their own hashes, of all such groups at once, after
each piece of a partition has combined those that it has itself. Extending a match to the left and right is
the union of its passages.

Words compare by 64-bit hashes. Two passages of a group that differ are taken for equal with a chance of
2**-48, those of large groups with 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Least words of a passage, words of a run, runs of a window, words beyond the run that a group shares.
PASSAGE, RUN = 50, 8
SPREAD = PASSAGE - RUN + 1
BEYOND = (PASSAGE - RUN) // 2
#: Words before an anchor, by side, that its passages reach; passages of a suffix; bytes of a passage's hash; suffixes that a group has at least to be a large one.
BEFORE = np.array([BEYOND, PASSAGE - RUN])
OFFSETS, WIDTH = BEYOND + 1, 6
LARGE_ROWS = 2048
#: Bound of the number of keys whose sizes are broadcast.
HOT_KEYS = 10_000


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and word place of each minimiser of the rows of words; rows of less than PASSAGE words have none."""
    rows, places = [], []
    runs = C.run_hashes(words, RUN)
    for k in np.flatnonzero(np.diff(first) >= PASSAGE):
        own = runs[first[k] : first[k + 1] - RUN + 1]
        at = np.unique(sliding_window_view(own, SPREAD).argmin(1) + np.arange(len(own) - SPREAD + 1))
        rows.append(np.full(len(at), k))
        places.append(at + first[k])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]).astype(np.int64), np.concatenate([none, *places]).astype(np.int64)


def _words(batch: pa.RecordBatch):
    buf, offs = C.text_bytes(batch.column("text"))
    for lo, hi in C.pieces(offs):
        starts, ends, first = C.word_spans(buf, offs[lo : hi + 1], C.NOT_SPACE)
        yield batch.slice(lo, hi - lo), C.word_hashes(buf, starts, ends), first


def _sides(words: np.ndarray, first: np.ndarray):
    """Row, word place, side and key of the suffixes of the rows of words."""
    row, at = anchors(words, first)
    long = C.run_hashes(words, RUN + BEYOND)
    right = at + RUN + BEYOND <= first[row + 1]
    left = at - BEYOND >= first[row]
    side = np.repeat(np.array([0, 1], np.int32), [right.sum(), left.sum()])
    return np.concatenate([row[right], row[left]]), np.concatenate([at[right], at[left]]), side, np.concatenate([long[at[right]], long[at[left] - BEYOND] ^ np.uint64(1)])


def keyed_anchors(rows: DataFrame) -> DataFrame:
    """(id, place, side, key): side 0 to the right of an anchor, 1 to its left; side 2 has a row's words in place."""

    def run(batch):
        for part, words, first in _words(batch):
            row, at, side, key = _sides(words, first)
            n = len(part)
            who = np.concatenate([row, np.arange(n)])
            place = np.concatenate([at - first[row], np.diff(first)])
            side = np.concatenate([side, np.full(n, 2, np.int32)])
            key = np.concatenate([key, np.zeros(n, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(who)), pa.array(place.astype(np.int32)), pa.array(side), pa.array(C.signed(key))], names=["id", "place", "side", "key"]
            )

    return C.map_batches(rows, run, "id long, place int, side int, key long")


def with_passages(rows: DataFrame) -> DataFrame:
    """rows: (id, text, wanted array<struct<place, side, key>>); for each wanted its passages: where the first begins, and 48 bits of a hash of each and its place from the anchor."""
    names = ["key", "hashes", "id", "start"]

    def run(batch):
        for part, words, first in _words(batch):
            wanted = part.column("wanted")
            count = pc.list_value_length(wanted).to_numpy(zero_copy_only=False)
            place, side, key = pc.struct_field(wanted.flatten(), [0]), pc.struct_field(wanted.flatten(), [1]), pc.struct_field(wanted.flatten(), [2])
            row = np.repeat(np.arange(len(part)), count)
            at = place.to_numpy() + first[row]
            reach = at - BEFORE[side.to_numpy()]
            lo, hi = np.maximum(reach, first[row]), np.minimum(reach + OFFSETS, first[row + 1] - PASSAGE + 1)
            size = np.maximum(hi - lo, 0)
            ends = np.concatenate([[0], np.cumsum(size)])
            which = np.arange(ends[-1]) + np.repeat(lo - ends[:-1], size)
            # with its place from the anchor, so that a passage that holds two anchors of a group isn't its own copy
            offset = (which - np.repeat(reach, size)).astype(np.uint64)
            small = (C.mix(C.run_hashes(words, PASSAGE)[which] + offset) >> np.uint64(16)).astype("<u8")
            data = small.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()
            hashes = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((ends * WIDTH).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([key, hashes, part.column("id").take(pa.array(row)), pa.array((lo - first[row]).astype(np.int32))], names=names)

    return C.map_batches(rows, run, "key long, hashes binary, id long, start int")


def compare_groups(sorted_rows: DataFrame) -> DataFrame:
    """(id, first, last): of each suffix the words of its passages that another suffix of its group has; a group is within a partition, in a row."""
    names = ["id", "first", "last"]

    def compared(table: pa.Table) -> pa.RecordBatch:
        column = table.column("hashes").combine_chunks()
        size = pc.binary_length(column).to_numpy() // WIDTH
        own = np.repeat(np.arange(len(size)), size)
        wide = np.zeros((len(own), 8), np.uint8)
        wide[:, :WIDTH] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)
        hashes = wide.view("<u8").ravel() ^ C.mix(table.column("key").to_numpy().view(np.uint64))[own]
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[which] > 1)
        who, begin = np.unique(own[again], return_index=True)
        end = np.append(begin, len(again))[1:] - 1
        start = table.column("start").to_numpy()[who] - (np.cumsum(size) - size)[who]
        first, last = start + again[begin], start + again[end] + PASSAGE
        return pa.RecordBatch.from_arrays([table.column("id").combine_chunks().take(pa.array(who)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=names)

    def run(batches):
        held: list = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            # the last group may go on in the next batch
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if cut:
                yield compared(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column("key")[-1].as_py() != key[0]:
                yield compared(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield compared(pa.Table.from_batches(held))

    return sorted_rows.mapInArrow(run, "id long, first int, last int")


def large_passages(rows: DataFrame, keys: list[int]) -> DataFrame:
    """(id, first, last, key): of the suffixes of the groups keys, the words of passages that a piece has twice, without a key, and each passage of a piece once, with its hash as the key."""
    large = rows.sparkSession.sparkContext.broadcast(np.sort(np.array(keys, np.int64)))

    def run(batch):
        for part, words, first in _words(batch):
            row, at, side, key = _sides(words, first)
            own = np.isin(C.signed(key), large.value)
            row, at, side, key = row[own], at[own], side[own], key[own]
            passages = C.run_hashes(words, PASSAGE)
            start = at - BEFORE[side] + np.arange(OFFSETS)[:, None]
            there = (start >= first[row]) & (start + PASSAGE <= first[row + 1]) & (start <= at) & (at + RUN <= start + PASSAGE)
            # one row for each place, whatever suffixes hold it
            who, place = np.divmod(np.unique((np.broadcast_to(row, start.shape)[there] << 32) | (start - first[row])[there]), 1 << 32)
            key, at, own, times = np.unique(passages[first[who] + place], return_index=True, return_inverse=True, return_counts=True)
            twice = times[own] > 1
            held, begin = who[twice], place[twice]
            new = np.flatnonzero(np.append(True, (held[1:] != held[:-1]) | (begin[1:] > begin[:-1] + PASSAGE))[: len(held)])
            ends = begin[np.append(new[1:] - 1, len(held) - 1)[: len(new)]] + PASSAGE
            who, begin, ends = np.concatenate([held[new], who[at]]), np.concatenate([begin[new], place[at]]), np.concatenate([ends, place[at] + PASSAGE])
            keys = pa.array(np.append(np.zeros(len(new), np.int64), C.signed(key)), mask=np.arange(len(who)) < len(new))
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(who)), pa.array(begin.astype(np.int32)), pa.array(ends.astype(np.int32)), keys], names=["id", "first", "last", "key"])

    return C.map_batches(rows, run, "id long, first int, last int, key long")


def sized(suffixes: DataFrame) -> DataFrame:
    """suffixes with n, the size of their group, without those that are alone in it."""
    total = suffixes.count()
    counts = suffixes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot = F.broadcast(counts.filter(F.col("n") * HOT_KEYS > total))
    cold = suffixes.join(hot.select("key"), "key", "left_anti").join(counts.filter(F.col("n") * HOT_KEYS <= total).hint("merge"), "key")
    return suffixes.join(hot, "key").unionByName(cold)


def merged(spans):
    """Column: sorted spans, overlapping and touching ones joined."""
    kind = "array<struct<first:int,last:int>>"

    def add(done, s):
        end = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], s["last"]).alias("last"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= s["first"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans, n_repeated) per id: merged [first, last) word spans of passages that occur again.

    Words are `[^\\x20\\x09-\\x0D]+`. Another place of the same document, and a repeated row, count as another
    occurrence; n_words of an id is that of its longest row. Null and short texts have no spans. Rows without
    an id are left out. An empty table gives an empty table.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    keyed = C.materialise(keyed_anchors(docs))
    suffixes = keyed.filter("side < 2")
    bound = max(LARGE_ROWS, suffixes.count() // HOT_KEYS)
    large = [r.key for r in suffixes.groupBy("key").count().filter(F.col("count") > bound).select("key").collect()]
    found = sized(suffixes).filter(F.col("n") <= bound)
    wanted = found.groupBy("id").agg(F.collect_list(F.struct("place", "side", "key")).alias("wanted"))
    parts = with_passages(docs.join(wanted.hint("merge"), "id")).repartition("key").sortWithinPartitions("key")
    spans = compare_groups(parts)
    if large:
        passages = C.materialise(large_passages(docs, large))
        again = sized(passages.filter("key is not null")).drop("key", "n").unionByName(passages.filter("key is null").drop("key"))
        spans = spans.unionByName(again)
    spans = spans.distinct().groupBy("id").agg(merged(F.collect_list(F.struct("first", "last"))).alias("spans"))
    rows = keyed.filter("side = 2").groupBy("id").agg(F.max("place").cast("long").alias("n_words"))
    empty = F.array().cast("array<struct<first:int,last:int>>")
    out = rows.join(spans, "id", "left").withColumn("spans", F.coalesce("spans", empty))
    repeated = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return out.select(F.col("id").alias(id_col), "n_words", "spans", repeated.alias("n_repeated"))
