"""Rows of two tables that share keys, counted by pairs of their owners without a row for each pair.

The right owners of a key travel as one value: integers as differences in as few bytes as they need, others as arrays.
A task meets the rows of a left owner one after the other and holds what it has counted of that one only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def pack(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Ascending integers as binary, a row from each place in first on: differences by seven bits a byte, the lowest first."""
    steps = np.diff(values.astype(np.int64).view(np.uint64), prepend=np.uint64(0))
    steps[first] = values[first].astype(np.int64).view(np.uint64)
    size = 1 + sum((steps >> np.uint64(7 * k) > 0).astype(np.int64) for k in range(1, 10))
    ends = np.cumsum(size)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        data[ends[live] - size[live] + k] = (steps[live] >> np.uint64(7 * k)).astype(np.uint8) & 127 | (size[live] > k + 1).astype(np.uint8) << 7
    offsets = np.append(ends[first] - size[first], len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all rows, and how many each row has; null has none."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size, steps = ends - starts + 1, np.zeros(len(ends), np.uint64)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        steps[live] |= (data[starts[live] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    first = np.searchsorted(ends, offs - offs[0])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64)])
    return (total[1:] - np.repeat(total[first[:-1]], np.diff(first))).view(np.int64), np.diff(first)


def _begins(column: pa.Array) -> np.ndarray:
    """Whether a row's value is another than that of the row before; null equals null."""
    if not len(column):
        return np.zeros(0, bool)
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate([[True], other])


def held(links: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, held): the distinct owners of each key, in one row or several; a null owner has a row of its own, with null. Null keys have none."""
    integers = isinstance(links.schema[owner].dataType, INTEGERS)
    kinds = [links.schema[c].dataType.simpleString() for c in (key, owner)]
    rows = links.select(key, owner).filter(F.col(key).isNotNull()).repartition(key).distinct().sortWithinPartitions(key, owner)

    def run(batches):
        for batch in batches:
            named = batch.filter(batch.column(1).is_valid())
            first = np.flatnonzero(_begins(named.column(0)))
            if integers:
                values = pack(named.column(1).to_numpy(zero_copy_only=False), first)
            else:
                values = pa.ListArray.from_arrays(pa.array(np.append(first, len(named)), pa.int32()), named.column(1))
            nameless = batch.filter(batch.column(1).is_null()).column(0)
            yield pa.RecordBatch.from_arrays([named.column(0).take(pa.array(first)), values], names=[key, "held"])
            yield pa.RecordBatch.from_arrays([nameless, pa.nulls(len(nameless), values.type)], names=[key, "held"])

    return rows.mapInArrow(run, f"{key} {kinds[0]}, held {'binary' if integers else f'array<{kinds[1]}>'}")


def _counted(own: np.ndarray, null: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple:
    """The sums of n by (own, null, value), in their order; the value of a null is any."""
    known, place = np.unique(value[~null], return_inverse=True)
    known, wide = known if len(known) else value[:1], max(1, len(known))
    value, place = place, np.zeros(len(null), np.int64)
    place[~null] = value
    key, at = np.unique((own * 2 + null) * wide + place, return_inverse=True)
    return key // (2 * wide), key // wide % 2 == 1, known[key % wide], np.bincount(at, n, len(key)).astype(np.int64)


def _best(own: np.ndarray, n: np.ndarray, limit: int) -> np.ndarray:
    """Places of the limit largest n of each own, of equal ones the first; rows are in the order of own."""
    once = np.cumsum(n == 1)
    start = np.searchsorted(own, own)
    # of those that are met once only the first can be among the best
    few = np.flatnonzero((n > 1) | (once - (once - (n == 1))[start] <= limit))
    order = few[np.lexsort((-n[few], own[few]))]
    return order[np.arange(len(order)) - np.searchsorted(own[order], own[order]) < limit]


def most_shared(left: DataFrame, right: DataFrame, key: str, own: str, other: str, shared: str, limit: int) -> DataFrame:
    """(own, other, shared): the limit owners of right (other, key) with the most distinct keys in common with each owner of left (own, key).

    Of equal ones the smallest go first, null last. Each key of an owner of left brings the packed owners of right.
    """
    integers = isinstance(right.schema[other].dataType, INTEGERS)
    kinds = [left.schema[own].dataType.simpleString(), right.schema[other].dataType.simpleString()]
    met = left.select(own, key).repartition(key).distinct().join(held(right, key, other), key).select(own, "held")
    names, kind = [own, other, shared], to_arrow_type(right.schema[other].dataType)

    def told(owners, c, null, value, n):
        at = _best(c, n, limit)
        return pa.RecordBatch.from_arrays([owners.take(pa.array(c[at])), pa.array(value[at].tolist(), kind, mask=null[at]), pa.array(n[at])], names=names)

    def run(batches):
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            owners, begins = batch.column(0), _begins(batch.column(0))
            if integers:
                value, size = unpack(batch.column(1))
            else:
                size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
                value = np.array(pc.list_flatten(batch.column(1)).to_pylist(), object)
            row = np.cumsum(begins) - 1
            nameless = row[batch.column(1).is_null().to_numpy(zero_copy_only=False)]
            c, n = np.concatenate([np.repeat(row, size), nameless]), np.ones(len(value) + len(nameless), np.int64)
            null, value = np.arange(len(c)) >= len(value), np.concatenate([value, np.zeros(len(nameless), value.dtype)])
            owners = owners.take(pa.array(np.flatnonzero(begins)))
            if kept is not None:
                both = pa.concat_arrays([kept[0], owners])
                if _begins(both.slice(0, 2))[1]:
                    owners, c = both, c + 1
                c, null, value, n = (np.concatenate(p) for p in ((np.zeros(len(kept[1]), np.int64), c), (kept[1], null), (kept[2], value), (kept[3], n)))
            c, null, value, n = _counted(c, null, value, n)
            done = c < len(owners) - 1
            kept = owners.slice(len(owners) - 1), null[~done], value[~done], n[~done]
            yield told(owners, c[done], null[done], value[done], n[done])
        if kept is not None:
            yield told(kept[0], np.zeros(len(kept[1]), np.int64), *kept[1:])

    return met.repartition(own).sortWithinPartitions(own).mapInArrow(run, f"{own} {kinds[0]}, {other} {kinds[1]}, {shared} long")

