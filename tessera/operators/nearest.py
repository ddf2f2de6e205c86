"""Exact nearest vectors by matrix products of blocks.

The side with fewer vectors is sent to the executors, in blocks of at most SENT_BYTES; the other stays where it is.
A task multiplies each batch of its rows with the block. Where the queries stay, their nearest are found in place;
where the vectors stay, each task keeps the k best of every query, and those meet in one shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a block that is sent, and scores of a product.
SENT_BYTES, SCORES = 32 << 20, 1 << 21


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of doubles; one of another length, or with an entry that is null or not finite, is zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dims))
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims)
    if len(rows) and dims:
        flat = pc.fill_null(pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64()), float("nan"))
        own = np.asarray(flat.to_numpy(zero_copy_only=False)).reshape(len(rows), dims)
        good = np.isfinite(own).all(1)
        out[rows[good]] = own[good]
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors, rounded to six places; negative ones are zero."""
    return np.round(np.maximum(a @ b.T, 0.0), 6)


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each query, and their ranks; of equal scores the smallest id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, query))
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < k], rank[rank < k] + 1


def _above(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row, or less than any where there are fewer."""
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -1.0)


def nearest(queries: DataFrame, vectors: DataFrame, q_id: str, v_id: str, k: int, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(q_id, v_id, score, rank): the k vectors of the largest cosine with each query; both have a column embedding.

    Score is rounded to six places and not negative, equal ones go by id. Rows without a vector are left out; vectors
    of another length than the most, or with entries that are null or not finite, score zero. Ids are unique.
    """
    q, v = (df.select(F.col(c).alias("id"), F.col("embedding").alias("e")).filter("e is not null") for df, c in ((queries, q_id), (vectors, v_id)))
    sizes = [df.agg(F.count(F.lit(1)).alias("n"), F.mode(F.size("e")).alias("dims")).first() for df in (q, v)]
    kinds = [df.schema["id"].dataType.simpleString() for df in (q, v)]
    schema = f"q {kinds[0]}, v {kinds[1]}, score double, rank int"
    dims, stay = (sizes[1].dims or 0), sizes[0].n > sizes[1].n
    rows, sent = (q, v) if stay else (v, q)
    n = sizes[1 if stay else 0].n
    blocks, found = max(1, -(-n * dims * 8 // sent_bytes)), []
    types = [_arrow(kind) for kind in kinds]
    for b in range(blocks if sizes[0].n and sizes[1].n else 0):
        table = (sent if blocks == 1 else sent.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow()
        if not len(table):
            continue
        held = sent.sparkSession.sparkContext.broadcast((np.array(table.column("id").to_pylist(), _kind(table.column("id").type)), matrix(table.column("e"), dims)))

        def in_place(batches, held=held):
            ids, block = held.value
            step = max(1, SCORES // len(ids))
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    s = scores(matrix(part.column("e"), dims), block)
                    own, other = np.nonzero(s >= _above(s, k)[:, None])
                    keep, rank = best(own, s[own, other], ids[other], k)
                    yield _rows([part.column("id").take(pa.array(own[keep])), pa.array(ids[other[keep]].tolist(), types[1]), s[own[keep], other[keep]], rank])

        def of_task(batches, held=held):
            ids, block = held.value
            step = max(1, SCORES // len(ids))
            query, score, mine, floor = np.zeros(0, np.int64), np.zeros(0), None, np.full(len(ids), -1.0)
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    s = scores(block, matrix(part.column("e"), dims))
                    own, other = np.nonzero(s >= np.maximum(_above(s, k), floor)[:, None])
                    new = np.array(part.column("id").to_pylist(), _kind(part.column("id").type))[other]
                    query, score, mine = np.concatenate([query, own]), np.concatenate([score, s[own, other]]), new if mine is None else np.concatenate([mine, new])
                    keep, rank = best(query, score, mine, k)
                    query, score, mine = query[keep], score[keep], mine[keep]
                    floor[query[rank == k]] = score[rank == k]
            if mine is not None:
                yield _rows([pa.array(ids[query].tolist(), types[0]), pa.array(mine.tolist(), types[1]), score, np.zeros(len(query), np.int64)])

        found.append(rows.mapInArrow(in_place if stay else of_task, schema))
    if not found:
        out = queries.sparkSession.createDataFrame([], schema)
    else:
        out = reduce(DataFrame.unionByName, found)
        if not stay or len(found) > 1:
            out = out.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "v"))).filter(F.col("rank") <= k)
    return out.select(F.col("q").alias(q_id), F.col("v").alias(v_id), "score", "rank")


def _kind(kind: pa.DataType):
    return np.int64 if pa.types.is_integer(kind) else object


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[name]


def _rows(columns: list) -> pa.RecordBatch:
    q, v, score, rank = columns
    return pa.RecordBatch.from_arrays([q, v, pa.array(score), pa.array(rank.astype(np.int32))], names=["q", "v", "score", "rank"])
