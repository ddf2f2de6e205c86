"""N-gram Jaccard join, size-aware: small sets enumerate subsets, large sets scan inverted lists.

1. A document's set is its distinct word shingles; equal sets are one class. Shingles are ordered by how many
   documents have one of their cell, rare cells first, then by hash. A sketch of fixed size counts the cells over all
   documents. A pair that reaches the similarity has its SUBSET first common shingles within the first
   n - least + SUBSET of each set of n, where least is the overlap that a set of n needs.
2. Small sets enumerate all subsets of SUBSET shingles of that prefix: two that link share one. Large sets, and
   the small ones that are large enough to link with them, are in inverted lists of the prefix for a single common
   shingle. The boundary is the size at which subsets and lists cost least, told from the sizes of all sets and
   the lists of every SHARE-th shingle. What stands after the first common shingles bounds the overlap, so members
   that by their sizes and places can link with no other member are left out, and gaps of sizes part a list.
3. Members of a subset or list are compared with its smallest id first, then with the most alike members
   of other components, then with all that are left; links are contracted to components in between, so
   groups that are one component are not looked at again. A bitmap of each set bounds the overlap of a pair
   exactly; pairs that pass are confirmed on their whole sets.

Shingles, subsets and sets are known by hashes of 64, 64 and 128 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.components import connected_components
from tessera.llm.minhash import shingles

NUM, DEN = 80, 100
#: Shingles of an enumerated subset.
SUBSET = 2
#: Cells of the sketch of frequencies, and the rows that they are added up in.
CELLS, SLICES = 1 << 22, 1024
#: Bits of the bitmap of a set of up to as many shingles; larger sets have the next power of two.
BITS = 1024
#: One in so many shingles has its list measured for the boundary.
SHARE = 64
#: Expected members of a group from which on it is dealt over salts.
SALT_ROWS = 1 << 14
#: Members of a group up to which each is held against all others by sizes and places; larger groups are parted by sizes only.
NEAR = 32
#: Partners of a member that are confirmed before the rest, and members of a block.
BEST, BLOCK = 3, 2048
#: Pairs that a task looks at together.
PAIRS = 1 << 19
#: Ids that may be broadcast to fetch their sets; more are joined.
BROADCAST_IDS = 1 << 20

_CELL_SHIFT = np.uint64(64 - CELLS.bit_length() + 1)


def least(n: np.ndarray) -> np.ndarray:
    """The overlap that a set of n shingles needs to link with any set."""
    return (NUM * n + DEN - 1) // DEN


def _sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every distinct shingle, by row and hash."""
    row, sh = shingles(buf, offs)
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    return row[new], sh[new]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)], pa.binary())


def _parities(sh: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Bitmaps of the sets between edges: each shingle turns over the bit that its low bits name."""
    n, out = np.diff(edges), [b""] * (len(edges) - 1)
    bits = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    for b in np.unique(bits):
        own = np.flatnonzero(bits == b)
        step = max(1, (1 << 18) // int(b))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            low = np.concatenate([sh[edges[i] : edges[i + 1]] for i in part]) & np.uint64(b - 1)
            odd = np.bincount(np.repeat(np.arange(len(part)) * b, n[part]) + low.astype(np.int64), minlength=len(part) * int(b)) & 1
            for i, row in zip(part, np.packbits(odd.astype(np.uint8).reshape(len(part), -1), axis=1), strict=True):
                out[i] = row.tobytes()
    return out


def _folded(bitmaps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows of so many words: halves of longer ones are laid over each other, as if made with fewer bits."""
    out, size = np.zeros((len(bitmaps), words), np.uint64), np.array([len(x) for x in bitmaps]) // 8
    for w in np.unique(size):
        own = np.flatnonzero(size == w)
        rows = np.frombuffer(b"".join([bitmaps[i] for i in own]), np.uint64).reshape(len(own), w)
        while rows.shape[1] > words:
            rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
        out[own] = rows
    return out


def rounded(counts: np.ndarray) -> np.ndarray:
    """Counts in two bytes each, the upper half of a float: the order stays, and up to 256 they are exact."""
    return (counts.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def counted(codes: np.ndarray) -> np.ndarray:
    """The counts that rounded() has made."""
    return (codes.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.int64)


def frequencies(docs: DataFrame) -> np.ndarray:
    """How many documents' sets have a shingle of each cell, rounded, over all rows of docs (with text)."""
    width = CELLS // SLICES

    def count(batches):
        cells = np.zeros(CELLS, np.int32)
        for batch in batches:
            buf, offs = C.text_bytes(batch.column("text"))
            for lo, hi in C.pieces(offs):
                cells += np.bincount((_sets(buf, offs[lo : hi + 1])[1] >> _CELL_SHIFT).astype(np.int64), minlength=CELLS).astype(np.int32)
        at = np.flatnonzero(cells.reshape(SLICES, width).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([zlib.compress(cells[s * width : (s + 1) * width].tobytes(), 1) for s in at], pa.binary())], names=["slice", "cells"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, part in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                held[s] = held.get(s, 0) + np.frombuffer(zlib.decompress(part), np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(rounded(x).tobytes(), 1) for x in held.values()], pa.binary())], names=["slice", "cells"])

    kind, out = "slice int, cells binary", np.zeros((SLICES, width), np.uint16)
    for r in docs.select("text").mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).collect():
        out[r.slice] = np.frombuffer(zlib.decompress(r.cells), np.uint16)
    return out.ravel()


def describe(docs: DataFrame, cells) -> DataFrame:
    """(id, n, digest, prefix, bits) per row of docs (id, text): the size of its set, the set's digest (null if empty), its rarest shingles and its bitmap."""

    def run(batch):
        buf, offs = C.text_bytes(batch.column("text"))
        for lo, hi in C.pieces(offs):
            rows = hi - lo
            row, sh = _sets(buf, offs[lo : hi + 1])
            edges = np.searchsorted(row, np.arange(rows + 1))
            n = np.diff(edges)
            digests = [hashlib.blake2b(sh[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(edges[:-1], edges[1:], strict=True)]
            ordered = sh[np.lexsort((sh, cells.value[(sh >> _CELL_SHIFT).astype(np.int64)], row))]
            kept = np.minimum(n, n - least(n) + SUBSET)
            prefix = ordered[np.arange(len(sh)) - np.repeat(edges[:-1], n) < np.repeat(kept, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, rows), pa.array(n), pa.array(digests, pa.binary()), _binary(prefix, np.cumsum(kept)), pa.array(_parities(sh, edges), pa.binary())],
                names=["id", "n", "digest", "prefix", "bits"],
            )

    return C.map_batches(docs.select("id", "text"), run, "id long, n long, digest binary, prefix binary, bits binary")


def _list_keys(prefix: np.ndarray) -> np.ndarray:
    return C.signed(C.mix(prefix) | np.uint64(1))


def boundary(sets: DataFrame) -> int:
    """The largest size of a set that enumerates subsets, at which subsets and lists cost least.

    A subset costs its row. An entry of a list costs its row and a visit to each entry of the list. Equal sets count
    once; the lists of every SHARE-th shingle are measured, whole, and stand for all.
    """
    kinds = F.floor(4 * F.log2("n")).cast("int")
    kept = F.least("n", F.col("n") - F.ceil(F.col("n") * NUM / DEN) + SUBSET)
    subsets = sets.select("n", "digest").distinct().groupBy(kinds.alias("size")).agg(F.sum(kept * (kept - 1) / 2).alias("subsets"), F.max("n").alias("most"))

    def run(batch):
        n = batch.column("n").to_numpy()
        keys = [_list_keys(np.frombuffer(p, np.uint64)[: n[i] - least(n[i]) + 1]) for i, p in enumerate(batch.column("prefix").to_pylist())]
        row = np.repeat(np.arange(len(n)), [len(k) for k in keys])
        keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        share = (keys >> 1) % SHARE == 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[share]), pa.array(n[row[share]]), batch.column("digest").take(pa.array(row[share]))], names=["key", "n", "digest"])

    some = C.map_batches(sets.select("n", "prefix", "digest"), run, "key long, n long, digest binary").distinct()
    # a list has one row for each kind of size, so its length is known without a join
    parts = some.groupBy("key", kinds.alias("size")).agg(F.count(F.lit(1)).alias("entries"))
    lists = parts.groupBy("key").agg(F.sum("entries").alias("length"), F.collect_list(F.struct("size", "entries")).alias("parts"))
    scans = lists.select("length", F.inline("parts")).groupBy("size").agg(F.sum(F.col("entries") * (F.col("length") + 1) * SHARE).alias("scans"))
    rows = subsets.join(scans, "size", "left").orderBy("size").collect()
    spared, most_spared, limit = 0.0, 0.0, 0
    for r in rows:
        spared += (r.scans or 0) - r.subsets
        if spared > most_spared:
            most_spared, limit = spared, r.most
    return limit


def keys(sets: DataFrame, limit: int, cells) -> DataFrame:
    """(key, id, n, most, salt): subsets of small sets and lists of large ones and their small neighbours; list keys are odd.

    A set of n whose first common shingles with another are those of the key has at most so many in common with it.
    """
    spread = max(SALT_ROWS, 8 * (sum(int(counted(x).sum()) for x in np.array_split(cells.value, SLICES)) // len(cells.value)))

    def run(batch):
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
            prefix = [np.frombuffer(p, np.uint64) for p in part.column("prefix").to_pylist()]
            size = np.array([len(p) for p in prefix])
            found: list[tuple] = []
            for p in np.unique(size[(n <= limit) & (size >= SUBSET)]):
                own = np.flatnonzero((n <= limit) & (size == p))
                i, j = np.triu_indices(int(p), 1)
                grid = np.stack([prefix[k] for k in own])
                key = C.mix(C.mix(grid[:, i]) + grid[:, j]) & ~np.uint64(1)
                count = cells.value[(grid >> _CELL_SHIFT).astype(np.int64)]
                most = n[own][:, None] - j + 1
                found.append((C.signed(key.ravel()), np.minimum(count[:, i], count[:, j]).ravel(), np.repeat(ids[own], len(i)), np.repeat(n[own], len(i)), most.ravel()))
            listed = np.flatnonzero(DEN * n >= NUM * (limit + 1))
            if len(listed):
                own = [prefix[k][: n[k] - least(n[k]) + 1] for k in listed]
                times, whole = np.array([len(o) for o in own]), np.concatenate(own)
                most = np.repeat(n[listed] + np.cumsum(times) - times, times) - np.arange(len(whole))
                found.append((_list_keys(whole), cells.value[(whole >> _CELL_SHIFT).astype(np.int64)], np.repeat(ids[listed], times), np.repeat(n[listed], times), most))
            if found:
                key, count, own, size, most = (np.concatenate(x) for x in zip(*found, strict=True))
                count = counted(count)
                salts = np.where(count > spread, count // spread + 1, 0)
                salt = np.where(salts > 0, 1 + (C.mix(own.view(np.uint64)) % np.maximum(salts, 1).astype(np.uint64)).astype(np.int64), 0)
                columns = [pa.array(key), pa.array(own), pa.array(size.astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(salt.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n", "most", "salt"])

    # zeros last: they and the next row's head are one run, which the shuffle's compression shortens
    return C.map_batches(sets.select("id", "n", "prefix"), run, "key long, id long, n int, most int, salt int")


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by columns; a group of the next batch waits for it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        same = np.ones(len(table), bool)
        for c in columns:
            x = table.column(c).to_numpy()
            same &= x == x[-1]
        # sorted: the last group is a suffix
        start = len(table) - int(same.sum())
        if start:
            yield table.slice(0, start)
        held = table.slice(start)
    if held is not None and len(held):
        yield held


def _starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    new = np.ones(len(table), bool)
    for k, c in enumerate(columns):
        x = table.column(c).to_numpy()
        new[1:] = (new[1:] if k else False) | (x[1:] != x[:-1])
    return np.flatnonzero(new)


def _partnered(group: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether another row of a row's group can have enough in common with it; group rises, and those over NEAR rows aren't looked at."""
    out = np.bincount(group)[group] > NEAR
    for d in range(1, NEAR):
        a = np.flatnonzero(group[d:] == group[:-d])
        if not len(a):
            break
        a = a[(NUM + DEN) * np.minimum(most[a], most[a + d]) >= NUM * (n[a] + n[a + d])]
        out[a] = out[a + d] = True
    return out


def members(rows: DataFrame, limit: int) -> DataFrame:
    """(key, id, hub): the members of every key that two ids share and can link by, with the smallest of them; lists without a large set are left out.

    A key's sizes may have gaps over which no sets link; the members between two gaps have a key of their own, unless the key is salted.
    """

    def run(batches):
        for table in _runs(batches, ["key", "salt"]):
            key, salt, ids, n, most = (table.column(c).to_numpy() for c in ("key", "salt", "id", "n", "most"))
            n, most, new = n.astype(np.int64), most.astype(np.int64), np.zeros(len(n), bool)
            new[_starts(table, ["key", "salt"])] = True
            new[1:] |= (salt[1:] == 0) & (DEN * n[:-1] < NUM * n[1:])
            at = np.flatnonzero(new)
            size, any_big = np.diff(np.append(at, len(n))), np.logical_or.reduceat(n > limit, at)
            live = np.flatnonzero(np.repeat((salt[at] > 0) | ((size > 1) & (any_big | ((key[at] & 1) == 0))), size))
            group = np.cumsum(new)[live] - 1
            fit = (salt[live] > 0) | _partnered(group, n[live], most[live])
            live, group = live[fit], group[fit]
            if len(live):
                first = np.flatnonzero(np.diff(group, prepend=-1))
                hub = np.repeat(np.minimum.reduceat(ids[live], first), np.diff(np.append(first, len(live))))
                own = np.where(salt[live] > 0, key[live], C.signed(C.mix(key[live].view(np.uint64) + n[at][group].astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(salt[live]), pa.array(ids[live]), pa.array(hub), pa.array(any_big[group])], names=["key", "salt", "id", "hub", "big"])

    # by size within a key
    grouped = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "n").mapInArrow(run, "key long, salt int, id long, hub long, big boolean")
    grouped = C.materialise(grouped)
    salted = grouped.filter("salt > 0").select("key", "id", "hub", "big")
    if salted.isEmpty():
        return grouped.select("key", "id", "hub")
    whole = C.materialise(salted.groupBy("key").agg(F.min("hub").alias("first"), F.max("big").alias("large"), F.count(F.lit(1)).alias("n")))
    shared = whole.filter("n > 1 and (large or key % 2 = 0)")
    hot = C.salted_join(salted.drop("hub", "big"), shared.select("key", F.col("first").alias("hub")), "key", counts=whole.select("key", "n"))
    return C.materialise(grouped.filter("salt = 0").select("key", "id", "hub").unionByName(hot.select("key", "id", "hub")))


class Bitmaps:
    """Bitmaps of rows, compared pair by pair at the bits of the shorter one."""

    def __init__(self, column) -> None:
        self.rows = column.to_pylist()
        self.words = np.array([len(x) for x in self.rows], np.int64) // 8
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each row stands among those of at least so many words, and these, folded."""
        if words not in self.held:
            own = np.flatnonzero(self.words >= words)
            place = np.zeros(len(self.rows), np.int64)
            place[own] = np.arange(len(own))
            self.held[words] = place, _folded([self.rows[i] for i in own], words)
        return self.held[words]

    def far(self, x: np.ndarray, other: Bitmaps, y: np.ndarray) -> np.ndarray:
        """Bits in which rows x differ from rows y of other, at most the size of the sets' symmetric difference."""
        words, out = np.minimum(self.words[x], other.words[y]), np.zeros(len(x), np.int64)
        for w in np.unique(words):
            part = np.flatnonzero(words == w)
            (i, a), (j, b) = self.at(int(w)), other.at(int(w))
            step = max(1, (1 << 20) // int(w))
            for at in range(0, len(part), step):
                p = part[at : at + step]
                out[p] = np.bitwise_count(a[i[x[p]]] ^ b[j[y[p]]]).sum(-1, dtype=np.int64)
        return out


def _possible(n: np.ndarray, m: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Whether sets of n and m that differ in at least far shingles can reach the similarity."""
    return (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)) & ((NUM + DEN) * (n + m - far) >= 2 * NUM * (n + m))


def prune(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (id, other) whose bitmaps leave the similarity possible."""
    x = sets.select("id", F.col("n").alias("n"), F.col("bits").alias("s"))
    y = sets.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("bits").alias("t"))
    counts = pairs.groupBy("other").agg(F.count(F.lit(1)).alias("n"))
    both = C.salted_join(pairs, y, "other", counts=counts).join(x, "id").filter(DEN * F.least("n", "m") >= NUM * F.greatest("n", "m"))

    def run(batch):
        every = np.arange(len(batch))
        far = Bitmaps(batch.column("s")).far(every, Bitmaps(batch.column("t")), every)
        keep = np.flatnonzero(_possible(batch.column("n").to_numpy(), batch.column("m").to_numpy(), far))
        yield batch.select(["id", "other"]).take(pa.array(keep))

    return C.map_batches(both.select("id", "other", "n", "m", "s", "t"), run, "id long, other long").distinct()


def fetch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own): the whole sets of ids, sorted; an id with several texts has several."""
    ids = C.materialise(ids)
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids.hint("merge"), "id", "left_semi")

    def run(batch):
        buf, offs = C.text_bytes(batch.column("text"))
        for lo, hi in C.pieces(offs):
            row, sh = _sets(buf, offs[lo : hi + 1])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), _binary(sh, np.searchsorted(row, np.arange(1, hi - lo + 1)))], names=["id", "own"])

    return C.map_batches(wanted.select("id", "text"), run, "id long, own binary")


def verify(pairs: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """The pairs whose whole sets reach the similarity; repeated says that an id may have several rows."""
    pairs = C.materialise(pairs)
    sets = fetch(docs, pairs.select("id").union(pairs.select(F.col("other").alias("id"))).distinct())
    sets = C.materialise(sets.distinct() if repeated else sets)
    counts = pairs.groupBy("other").agg(F.count(F.lit(1)).alias("n"))
    both = C.salted_join(pairs.join(sets.withColumnRenamed("own", "a"), "id"), sets.select(F.col("id").alias("other"), F.col("own").alias("b")), "other", counts=counts)

    def run(batch):
        keep = []
        for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            if len(a) and len(b):
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                common = int((a[at] == b).sum())
                if DEN * common >= NUM * (len(a) + len(b) - common):
                    keep.append(i)
        yield batch.select(["id", "other"]).take(pa.array(keep, pa.int64()))

    return C.materialise(C.map_batches(both.select("id", "other", "a", "b"), run, "id long, other long").distinct())


def _pairs_of(table: pa.Table, group: np.ndarray, best: int) -> np.ndarray:
    """Possible pairs of an own row and another of its group with a different component; with best, the so many most alike of each own row.

    group numbers the rows' groups, rising; the pairs of all groups are looked at PAIRS at a time.
    """
    ids, comp, n, own = (table.column(c).to_numpy() for c in ("id", "comp", "n", "own"))
    bits, mine, others = Bitmaps(table.column("bits")), np.flatnonzero(own), np.flatnonzero(~own)
    first, last = (np.searchsorted(group[others], group[mine], side) for side in ("left", "right"))
    ends, out = np.cumsum(last - first), [np.zeros((0, 2), np.int64)]
    at = 0
    while at < len(mine):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        count = (last - first)[at:end]
        x = np.repeat(mine[at:end], count)
        y = others[np.arange(len(x)) + np.repeat(first[at:end] - (np.cumsum(count) - count), count)]
        live = (comp[x] != comp[y]) & (DEN * np.minimum(n[x], n[y]) >= NUM * np.maximum(n[x], n[y]))
        x, y = x[live], y[live]
        far = bits.far(x, bits, y)
        keep = _possible(n[x], n[y], far)
        x, y, far = x[keep], y[keep], far[keep]
        if best:
            order = np.lexsort((far / (n[x] + n[y]), x))
            x, y = x[order], y[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            x, y = x[place < best], y[place < best]
        out.append(np.column_stack([ids[x], ids[y]]))
        at = end
    pairs = np.concatenate(out)
    return np.unique(np.column_stack([pairs.max(1), pairs.min(1)]), axis=0) if len(pairs) else pairs


def block_pairs(shared: DataFrame, comps: DataFrame, sets: DataFrame, best: int, block: int) -> DataFrame:
    """Possible pairs (id, other) of different components within each key of shared, block by block.

    Members of a key's largest component aren't compared with each other: each of the rest is compared with all members.
    Of n members and u of these rest, blocks of the rest meet blocks of all, so a member is there u / block times.
    With best, each of the rest is compared within two of its keys, the same two for all that share them.
    """
    placed = shared.select("key", "id").join(comps.withColumnRenamed("node", "id"), "id", "left")
    placed = C.materialise(placed.select("key", "id", F.coalesce("component", "id").alias("comp")))
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    sizes = C.materialise(parts.agg(F.sum("c").alias("n"), F.max("c").alias("top_n"), F.max_by("comp", F.struct("c", "comp")).alias("top")))
    open_keys = sizes.filter("n > top_n").select("key", "top", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("top_n")) / block).cast("int").alias("rests"))
    rows = C.salted_join(placed, open_keys, "key", counts=sizes.select("key", "n")).withColumn("rest", F.expr("comp <> top"))
    if best:
        rows = C.materialise(rows)
        ends = rows.filter("rest").groupBy("id").agg(F.min("key").alias("a"), F.max("key").alias("b"))
        chosen = ends.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        rows = C.salted_join(rows, chosen, "key", counts=sizes.select("key", "n")).join(ends, "id", "left").withColumn("rest", F.expr("rest and (key = a or key = b)"))
    hashed = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    # each row is dealt to all blocks of the rest, and as one of the rest to all blocks of all; as one table, so that rows are made once
    times = F.col("rests") + F.when(F.col("rest"), F.col("blocks")).otherwise(0)
    rows, own = rows.withColumn("at", F.explode(F.sequence(F.lit(0), times - 1))), F.col("at") >= F.col("rests")
    i, j = F.when(own, hashed("rests", 2)).otherwise(F.col("at")), F.when(own, F.col("at") - F.col("rests")).otherwise(hashed("blocks", 1))
    rows, group = rows.select("key", i.alias("i"), j.alias("j"), "id", "comp", own.alias("own")).join(sets, "id"), ["key", "i", "j"]

    def run(batches):
        for table in _runs(batches, group):
            table, new = table.combine_chunks(), np.zeros(len(table), np.int64)
            new[_starts(table, group)] = 1
            pairs = _pairs_of(table, np.cumsum(new), best)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["id", "other"])

    # dealt over a stated number of partitions, as rows are few for the work on them
    count = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, *group).sortWithinPartitions(*group).mapInArrow(run, "id long, other long").distinct()


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, n, class) for each row of df, links (id, other) between classes that join every component, and the components (node, component) of linked classes.

    A class is named by its smallest id. Links reach the similarity; of those within a component that other links
    join already, not all are there. limit sets the boundary between small and large sets.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cells = df.sparkSession.sparkContext.broadcast(frequencies(docs))
    rows = C.materialise(describe(docs, cells))
    some = rows.filter("digest is not null and id is not null")
    classes = C.materialise(some.groupBy("digest").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")))
    firsts = classes.select("digest", F.col("class").alias("id"))
    # by digest and id, so that a class of many copies is no hot key
    sets = some.join(firsts.hint("shuffle_hash"), ["digest", "id"], "left_semi")
    repeated = not some.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty()
    sets = sets.dropDuplicates(["digest", "id"]) if repeated else sets
    limit = boundary(some) if limit is None else limit
    shared = members(keys(sets, limit, cells), limit)
    listed = shared.select("id").distinct()
    bitmaps = C.materialise(sets.select("id", "n", "bits").join(listed.hint("shuffle_hash"), "id", "left_semi"))

    named = classes.filter("copies > 1").select("digest", "class")
    out = C.salted_join(rows.select("id", "n", "digest"), named, "digest", "left", classes.select("digest", F.col("copies").alias("n")))
    out = C.materialise(out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class")))
    stars = C.materialise(shared.filter("id <> hub").select("id", F.col("hub").alias("other")).distinct())
    tried = C.materialise(prune(stars, bitmaps))
    links = verify(tried, docs, repeated)
    if repeated:
        # an id is one document, so its texts' classes are linked
        same = out.filter("id is not null and n > 0")
        low = same.groupBy("id").agg(F.min("class").alias("other"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n")).filter("other <> high")
        links = links.unionByName(C.materialise(C.salted_join(same.select("id", "class"), low.select("id", "other"), "id").filter("class <> other").select(F.col("class").alias("id"), "other").distinct()))
    comps = C.materialise(connected_components(links, "id", "other"))
    for best in (BEST, 0):
        near = C.materialise(block_pairs(shared, comps, bitmaps, best, block).join(tried, ["id", "other"], "left_anti"))
        found = verify(near, docs, repeated) if not near.isEmpty() else near
        if not found.isEmpty():
            links = links.unionByName(found)
            comps = C.materialise(connected_components(links, "id", "other"))
        tried = tried.unionByName(near)
    cells.unpersist()
    return out, links, comps


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, limit: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for each row; component_id is the smallest id reachable by links.

    Null and blank texts have no shingles and stand alone. Ids are integers; rows without an id have no component.
    Repeated rows give repeated rows; rows of one id with several texts are one document that links through each
    of them. An empty table gives an empty table. Other columns are not looked at.
    """
    rows, _, comps = linked(df, id_col, text_col, block, limit)
    out = C.salted_join(rows, comps.select(F.col("node").alias("class"), "component"), "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("component_id"))
