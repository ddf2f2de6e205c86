"""Ranked lexical search over a length-stratified index.

1. A document's normaliser m depends on its length alone. Documents of equal m form strata of at most STRATUM
   documents, dealt over partitions by m; where one m has very many documents they are salted.
2. A stratum has, for each term, its documents grouped by tf. As m is the same for all of them, the impact of a
   tf is computed once, and the largest tf of a term bounds what it adds to any score of the stratum.
3. A search first reads the heads of all strata (terms, counts, largest tf): document frequencies, and for each
   item the stratum of the largest bound. What these strata hold gives each item a floor. Then every task visits
   its strata item by item in falling order of their bounds, until a bound is under the floor.

Terms are known by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

#: Documents of a stratum, and postings from which on it is closed earlier.
STRATUM, POSTINGS = 1024, 1 << 18
#: Lengths with more than a HOT-th of all documents are salted, so they are at most HOT and may be broadcast.
HOT = 10_000
#: Bytes of items that are searched for at once.
ITEM_BYTES = 8 << 20
#: Documents of an item.
BEST = 10

#: Bytes of terms `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`.
TERM = C.byte_class([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

HEADS = "stratum long, m long, terms binary, counts binary, tops binary"
INDEX = f"{HEADS}, docs binary, tfs binary, sizes binary, places binary"


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes: the values up to each end."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    if offsets[-1] >= 1 << 31:
        return pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1] // values.itemsize, ends, strict=True)], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _array(cell: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def lengths(df: DataFrame) -> DataFrame:
    """(n, docs): documents of df (with id and text) by their number of terms."""

    def run(batch):
        buf, offs = C.text_bytes(batch.column("text"))
        for lo, hi in C.pieces(offs):
            _, _, first = C.word_spans(buf, offs[lo : hi + 1], TERM)
            n, docs = np.unique(np.diff(first), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(docs)], names=["n", "docs"])

    return C.map_batches(df.select("text"), run, "n long, docs long").groupBy("n").agg(F.sum("docs").alias("docs"))


def term_counts(df: DataFrame) -> DataFrame:
    """(id, n, terms, tfs) per row of df (with id and text): its terms with repeats, its distinct terms by hash, and how often each occurs."""

    def run(batch):
        buf, offs = C.text_bytes(batch.column("text"))
        for lo, hi in C.pieces(offs):
            starts, ends, first = C.word_spans(buf, offs[lo : hi + 1], TERM)
            n = np.diff(first)
            row, term = np.repeat(np.arange(hi - lo), n), C.word_hashes(buf, starts, ends)
            order = np.lexsort((term, row))
            row, term = row[order], term[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(term))).astype(np.int32)
            ends = np.searchsorted(row[at], np.arange(1, hi - lo + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(n), _binary(term[at], ends), _binary(tf, ends)], names=["id", "n", "terms", "tfs"])

    kind = df.schema["id"].dataType.simpleString()
    return C.map_batches(df.select("id", "text"), run, f"id {kind}, n long, terms binary, tfs binary")


def _stratum(number: int, m: int, ids: list[int], terms: list[np.ndarray], tfs: list[np.ndarray]) -> dict:
    """One row of the index from documents of equal m."""
    place = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in terms])
    term, tf = np.concatenate(terms), np.concatenate(tfs)
    order = np.lexsort((place, -tf, term))
    place, term, tf = place[order], term[order], tf[order]
    new_term = np.ones(len(term), bool)
    new_term[1:] = term[1:] != term[:-1]
    new_group = new_term.copy()
    new_group[1:] |= tf[1:] != tf[:-1]
    at, groups = np.flatnonzero(new_term), np.flatnonzero(new_group)
    arrays = {
        "terms": term[at], "counts": np.diff(np.append(at, len(term))).astype(np.int32), "tops": tf[at], "docs": np.array(ids, np.int64),
        "tfs": tf[groups], "sizes": np.diff(np.append(groups, len(term))).astype(np.int32), "places": place,
    }
    return {"stratum": number, "m": m} | {k: a.tobytes() for k, a in arrays.items()}


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index of df, written to the shared folder, and the number of documents with a term.

    Ids are integers; rows without an id, a text or a term are no documents. Repeated rows are documents of their
    own. An empty table gives an empty index.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    sizes = C.materialise(lengths(docs).filter("n > 0"))
    total, words = sizes.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    if not total:
        return df.sparkSession.createDataFrame([], INDEX), 0
    hot = F.broadcast(sizes.filter(F.col("docs") > max(STRATUM, total // HOT)).select("n", F.ceil(F.col("docs") / STRATUM).cast("long").alias("salts")))
    rows = term_counts(docs).filter("n > 0").join(hot, "n", "left")
    rows = rows.withColumn("m", F.expr(f"100 - 90 + ((90 * n * {total}) div {words})")).withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1).cast("long"))))
    rows = rows.select("m", "salt", "id", "terms", "tfs").repartition("m", "salt").sortWithinPartitions("m")

    def run(batches: Iterator[pa.RecordBatch]):
        part, made, held, m, postings = TaskContext.get().partitionId(), 0, ([], [], []), None, 0
        for batch in batches:
            for i in range(len(batch)):
                own = batch.column("m")[i].as_py()
                if held[0] and (own != m or len(held[0]) >= STRATUM or postings >= POSTINGS):
                    yield pa.RecordBatch.from_pylist([_stratum(part << 32 | made, m, *held)], schema)
                    made, held, postings = made + 1, ([], [], []), 0
                m = own
                held[0].append(batch.column("id")[i].as_py())
                held[1].append(np.frombuffer(batch.column("terms")[i].as_py(), np.uint64))
                held[2].append(np.frombuffer(batch.column("tfs")[i].as_py(), np.int32))
                postings += len(held[1][-1])
        if held[0]:
            yield pa.RecordBatch.from_pylist([_stratum(part << 32 | made, m, *held)], schema)

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in INDEX.split(", ")])
    return C.materialise(rows.mapInArrow(run, INDEX)), total


class Items:
    """Distinct terms of the items that are searched for at once; sent to the executors."""

    def __init__(self, own: list[np.ndarray]) -> None:
        self.n, self.starts = len(own), np.concatenate([[0], np.cumsum([len(o) for o in own])]).astype(np.int64)
        self.vocabulary, self.term = np.unique(np.concatenate(own), return_inverse=True)
        self.weight = np.zeros(len(self.term), np.int64)

    def weigh(self, df: dict[int, int], total: int) -> None:
        logs = [math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(self.vocabulary))]
        self.weight = np.array(logs, np.int64)[self.term]

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each term of the vocabulary among a stratum's terms, and whether it is there."""
        at = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        return at, terms[at] == self.vocabulary

    def bounds(self, m: int, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """For each item a score that no document of the stratum exceeds."""
        at, there = self.found(terms)
        most = np.where(there, impacts(tops[at], m), 0)
        return np.add.reduceat(self.weight * most[self.term], self.starts[:-1])


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """What a weight is multiplied by, computed once for each tf."""
    each, at = np.unique(tf, return_inverse=True)
    each = each.astype(np.int64)
    return ((1_000_000_000 * each) // (1000 * each + 8 * m))[at]


def document_frequencies(index: DataFrame, items) -> dict[int, int]:
    """Documents that hold each term of the vocabulary, by its number there."""

    def run(batches):
        total = np.zeros(len(items.value.vocabulary), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                at, there = items.value.found(_array(batch.column("terms")[i], np.uint64))
                total += np.where(there, _array(batch.column("counts")[i], np.int32)[at], 0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "df"])

    rows = index.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.collect()}


def best_strata(index: DataFrame, items) -> DataFrame:
    """(stratum): for each item that of its largest bound."""

    def run(batches):
        best, where = np.zeros(items.value.n, np.int64), np.full(items.value.n, -1)
        for batch in batches:
            for i in range(len(batch)):
                bound = items.value.bounds(batch.column("m")[i].as_py(), _array(batch.column("terms")[i], np.uint64), _array(batch.column("tops")[i], np.int32))
                better = bound > best
                best[better], where[better] = bound[better], batch.column("stratum")[i].as_py()
        seen = np.flatnonzero(where >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(best[seen]), pa.array(where[seen])], names=["item", "bound", "stratum"])

    rows = index.select("stratum", "m", "terms", "tops").mapInArrow(run, "item long, bound long, stratum long")
    return rows.groupBy("item").agg(F.max_by("stratum", "bound").alias("stratum")).select("stratum").distinct()


class Visit:
    """The postings of a stratum that items ask for."""

    def __init__(self, row: dict, items: Items) -> None:
        terms, sizes = _array(row["terms"], np.uint64), _array(row["sizes"], np.int32).astype(np.int64)
        self.docs = _array(row["docs"], np.int64)
        self.impact, self.places = np.repeat(impacts(_array(row["tfs"], np.int32), row["m"].as_py()), sizes), _array(row["places"], np.int32)
        at, there = items.found(terms)
        counts = _array(row["counts"], np.int32).astype(np.int64)
        self.start, self.size = (np.cumsum(counts) - counts)[at], np.where(there, counts[at], 0)

    def scores(self, items: Items, item: int, bound: int) -> np.ndarray:
        own = slice(items.starts[item], items.starts[item + 1])
        term, weight = items.term[own], items.weight[own]
        size = self.size[term]
        at = np.arange(size.sum()) + np.repeat(self.start[term] - (np.cumsum(size) - size), size)
        parts = np.repeat(weight, size) * self.impact[at]
        if bound < 1 << 53:  # doubles hold every sum
            return np.bincount(self.places[at], parts, len(self.docs)).astype(np.int64)
        out = np.zeros(len(self.docs), np.int64)
        np.add.at(out, self.places[at], parts)
        return out


def _search(index: DataFrame, items, floors: np.ndarray, best: int) -> DataFrame:
    """(item, doc_id, score): for each task and item its best documents with scores of at least the item's floor and above 0."""

    def run(batches):
        asked, floor = items.value, floors.copy()
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * asked.n
        for batch in batches:
            cells = [{c: batch.column(c)[i] for c in batch.schema.names} for i in range(len(batch))]
            bounds = np.array([asked.bounds(r["m"].as_py(), _array(r["terms"], np.uint64), _array(r["tops"], np.int32)) for r in cells]).reshape(len(cells), asked.n)
            visits: dict[int, Visit] = {}
            for item in range(asked.n):
                for s in np.argsort(-bounds[:, item], kind="stable"):
                    bound = int(bounds[s, item])
                    if bound < max(1, floor[item]):
                        break
                    if s not in visits:
                        visits[s] = Visit(cells[s], asked)
                    score = visits[s].scores(asked, item, bound)
                    at = np.flatnonzero(score >= max(1, floor[item]))
                    score, docs = np.concatenate([top[item][0], score[at]]), np.concatenate([top[item][1], visits[s].docs[at]])
                    order = np.lexsort((docs, -score))[:best]
                    top[item] = (score[order], docs[order])
                    if len(order) == best:
                        floor[item] = max(floor[item], int(score[order[-1]]))
        sizes = [len(t[0]) for t in top]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(asked.n), sizes)), pa.array(np.concatenate([t[1] for t in top])), pa.array(np.concatenate([t[0] for t in top]))], names=["item", "doc_id", "score"]
            )

    columns = [c for c in index.columns if c != "stratum"]
    return index.select(*columns).mapInArrow(run, "item long, doc_id long, score long")


def _ranked(rows: DataFrame, best: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= best)


def search(index: DataFrame, total: int, queries: DataFrame, item_col: str = "item_id", text_col: str = "text", best: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, of total documents in the index.

    An item's terms are those of all its rows, once each; rows without an id are no items, and items without a term
    that a document holds have no rows. Equal scores go by ascending id. Items are searched for in blocks of about
    item_bytes, each block sent to the executors.
    """
    spark = index.sparkSession
    asked = queries.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    asked = C.materialise(term_counts(asked).filter("n > 0").select("id", "terms"))
    size = asked.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    kind = asked.schema["id"].dataType.simpleString()
    schema = f"{item_col} {kind}, rank int, doc_id long, score long"
    found, blocks = [], max(1, -(-size // item_bytes))
    for b in range(blocks if total and size else 0):
        merged: dict = {}
        for r in (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).collect():
            merged[r.id] = np.union1d(merged[r.id], np.frombuffer(r.terms, np.uint64)) if r.id in merged else np.frombuffer(r.terms, np.uint64)
        if not merged:
            continue
        names = sorted(merged)
        items = Items([merged[k] for k in names])
        counted = spark.sparkContext.broadcast(items)
        items.weigh(document_frequencies(index, counted), total)
        held, floors = spark.sparkContext.broadcast(items), np.zeros(len(names), np.int64)
        first = index.join(F.broadcast(best_strata(index, held)), "stratum", "left_semi")
        for r in _ranked(_search(first, held, floors, best), best).filter(F.col("rank") == best).collect():
            floors[r.item] = r.score
        told = spark.createDataFrame(list(enumerate(names)), f"item long, {item_col} {kind}")
        rows = _ranked(_search(index, held, floors, best), best).join(F.broadcast(told), "item")
        found.append(C.materialise(rows.select(item_col, "rank", "doc_id", "score")))
        counted.unpersist()
        held.unpersist()
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ranked(df: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", best: int = BEST) -> DataFrame:
    """search() over build_index(): the documents of df ranked for each item of queries."""
    index, total = build_index(df, id_col, text_col)
    return search(index, total, queries, item_col, item_text, best).withColumnRenamed("doc_id", id_col)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
sizes AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
weights AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN dfs USING (term), totals),
norms AS (SELECT r, doc_id, 100 - 90 + ((90 * n * docs) // words) AS m FROM sizes, totals),
scores AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM weights JOIN tfs USING (term) JOIN norms USING (r) GROUP BY item_id, r, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 10
"""
