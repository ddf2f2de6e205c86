"""Shared helpers: tables in the shared folder, and words of an Arrow text column as numpy arrays.

A word is hashed by a polynomial over its bytes, so equal words have equal hashes wherever they
stand; all functions work on bounded pieces of a batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and documents of one piece of a batch.
PIECE_BYTES, PIECE_DOCS = 4 << 20, 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of its own only where a local session names none, else that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def private(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    name, taken = f"_{name}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a key from which on it is split; keys that are split are at most this many, so they may be broadcast.
SALT_ROWS, HOT_KEYS = 4096, 10_000


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined to right on key; right has a key once. Rows of frequent keys of left are dealt over salts.

    A key is frequent with more than a HOT_KEYS-th of left's rows, and more than SALT_ROWS; each row of right with
    such a key is there once for each of its salts. counts (key, n), of left's keys, spares reading left for
    them. Null keys match nothing; with how left they stay, and are dealt over all partitions.
    """
    total = left.count() if counts is None else counts.agg(F.sum("n")).first()[0] or 0
    if total <= SALT_ROWS:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    salts, salt = private(left, "salts"), private(left, "salt")
    hot = counts.filter(F.col(key).isNotNull() & (F.col("n") > max(SALT_ROWS, total // HOT_KEYS)))
    hot = F.broadcast(hot.select(key, F.ceil(F.col("n") / SALT_ROWS).cast("long").alias(salts)))
    dealt = F.xxhash64(*([c for c in left.columns if c != key] or [key]))
    rows = left.join(hot, key, "left").withColumn(salt, F.when(F.col(key).isNull(), dealt).otherwise(F.pmod(dealt, F.coalesce(salts, F.lit(1).cast("long"))))).drop(salts)
    copies = right.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(salts, F.lit(1).cast("long")) - 1))).drop(salts)
    return rows.join(copies, [key, salt], how).drop(salt)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def pieces(offs: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes each; a longer row stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + PIECE_DOCS)
        yield lo, hi
        lo = hi


def byte_class(outside: Iterator[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(outside)] = False
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = byte_class([0x20, *range(0x09, 0x0E)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
ALNUM = byte_class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Words of a run from which on its hash is a difference of sums, and the runs of one sum.
LONG_RUN, STRETCH = 12, 1 << 16
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions in buf) of the words of the rows offs, and each row's first word."""
    lo, hi = int(offs[0]), int(offs[-1])
    inside = np.zeros(hi - lo + 2, np.bool_)
    inside[1:-1] = table[buf[lo:hi]]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offs[1:-1] - lo
    edges = edges[(edges > 0) & (edges < hi - lo)]
    first[edges] = inside[1:-1][edges]
    last[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first) + lo, np.flatnonzero(last) + lo + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE_BYTES, "right")))
        size = int(ends[j - 1]) - lo
        up, down = powers(size + 1)
        total = np.empty(size + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[LOWER[buf[lo : lo + size]]] * up[:size], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes (row boundaries are not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    if k > LONG_RUN:
        # sums of words times powers, each begun anew for a stretch that stays in the cache
        up, down = powers(STRETCH + k)
        for lo in range(0, n, STRETCH):
            size = min(STRETCH, n - lo)
            total = np.zeros(size + k, np.uint64)
            np.cumsum(words[lo : lo + size + k - 1] * up[: size + k - 1], out=total[1:])
            out[lo : lo + size] = (total[k:] - total[:size]) * down[:size]
        return mix(out)
    for i in range(k):
        out *= np.uint64(_BASE)
        out += words[i : i + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with a function from one record batch to one batch or an iterator of batches."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)
