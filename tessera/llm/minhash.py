"""MinHash near-dedup with sequential Bayesian verification of banded candidates.

1. Every text becomes a signature of PERMUTATIONS minima over its distinct word shingles; texts with the
   same words are one class, represented by its smallest id.
2. Representatives that share a band of ROWS minima are candidates. Each is compared with the smallest id
   of its bucket, which is linear in a bucket of any size.
3. Signatures are compared a batch at a time: a pair is given up as soon as the posterior probability that
   its similarity reaches the threshold, given the agreements so far, is under MISS. Survivors are compared
   on their full shingle sets.
4. Links are contracted to components. Buckets that still hold several components are compared in blocks,
   each pair of different components, the most alike first, so that no candidate is lost; survivors are
   verified as before.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.components import connected_components

SHINGLE, NUM, DEN = 5, 75, 100
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
#: Signature values compared at a time, and the chance of giving up a pair that reaches the threshold.
BATCH, MISS = 16, 1e-5
#: Partners of a row that are verified before the rest of a bucket with several components.
BEST = 2
#: Rows of a block of a bucket with several components.
BLOCK = 4096

_rng = np.random.default_rng(7919)
_XOR = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)

SIGNED_SCHEMA = "id long, n_shingles long, words binary, sig binary"


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every shingle of the rows offs, in row order; fewer than k words make one."""
    starts, ends, first = C.word_spans(buf, offs, C.NOT_SPACE)
    words = C.word_hashes(buf, starts, ends)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    if len(words) >= k:
        inside = row[: len(row) - k + 1] == row[k - 1 :]
        sh, sr = C.run_hashes(words, k)[inside], row[: len(row) - k + 1][inside]
    else:
        sh, sr = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = [C.run_hashes(words[first[i] : first[i + 1]], int(count[i]))[0] ^ np.uint64(count[i]) for i in short]
        sh, sr = np.concatenate([sh, np.array(extra, np.uint64)]), np.concatenate([sr, short])
        order = np.argsort(sr, kind="stable")
        sh, sr = sh[order], sr[order]
    return sr, sh


def distinct_counts(row: np.ndarray, sh: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    edges = np.searchsorted(row, np.arange(n + 1))
    long = np.flatnonzero(np.diff(edges) > 1 << 14)
    for i in long:
        out[i] = len(np.unique(sh[edges[i] : edges[i + 1]]))
    small = ~np.isin(row, long) if len(long) else slice(None)
    key = (row[small].astype(np.uint64) << np.uint64(52)) | (sh[small] >> np.uint64(12))
    key.sort()
    if len(key):
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        out += np.bincount((key[new] >> np.uint64(52)).astype(np.int64), minlength=n)
    return out


def minima(row: np.ndarray, sh: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n x PERMUTATIONS, 16 bits of each minimum); rows without shingles are zero."""
    out = np.zeros((n, PERMUTATIONS), np.uint16)
    if len(sh):
        has, at = np.unique(row, return_index=True)
        x = (sh >> np.uint64(32)).astype(np.uint32)
        for p in range(PERMUTATIONS):
            out[has, p] = np.minimum.reduceat((x ^ _XOR[p]) * _MUL[p], at).astype(np.uint16)
    return out


def sign(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batch):
        ids = batch.column(0)
        buf, offs = C.text_bytes(batch.column(1))
        for lo, hi in C.pieces(offs):
            n, part = hi - lo, offs[lo : hi + 1]
            row, sh = shingles(buf, part)
            sig = minima(row, sh, n)
            words = []
            for i in range(n):
                w = buf[part[i] : part[i + 1]].tobytes().lower().split()
                words.append(hashlib.sha256(b" ".join(w)).digest() if w else None)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, n), pa.array(distinct_counts(row, sh, n)), pa.array(words, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["id", "n_shingles", "words", "sig"],
            )

    return C.map_batches(df.select(F.col(id_col).cast("long"), text_col), run, SIGNED_SCHEMA)


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)


def bands(reps: DataFrame) -> DataFrame:
    """(bucket, id): a row for each band of each signature; the low bits of a bucket are its band."""

    def run(batch):
        sig = signatures(batch.column("sig")).astype(np.uint64)
        for at in range(0, len(sig), 4096):
            part = sig[at : at + 4096].reshape(-1, BANDS, ROWS)
            key = np.zeros(part.shape[:2], np.uint64)
            for r in range(ROWS):
                key = (key << np.uint64(16)) | part[:, :, r]
            key = (C.mix(key) & ~np.uint64(BANDS - 1)) | np.arange(BANDS, dtype=np.uint64)
            ids = np.repeat(batch.column("id").slice(at, len(part)).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(key.ravel())), pa.array(ids)], names=["bucket", "id"])

    return C.map_batches(reps.select("id", "sig"), run, "bucket long, id long")


@lru_cache
def least_agreements() -> tuple[int, ...]:
    """For each number of values compared, the agreements below which a pair is given up.

    The prior of the similarity is uniform; with m of n agreements its posterior is Beta(m+1, n-m+1), and
    P(similarity >= t) is the binomial sum of at most m successes of n + 1 at t.
    """
    from math import comb

    t, out = NUM / DEN, []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        total, m = 0.0, 0
        while total + (p := comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < MISS:
            total, m = total + p, m + 1
        out.append(m)
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row numbers of the pairs of signatures that no batch gives up."""
    live, agree = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, least in enumerate(least_agreements()):
        cols = slice(step * BATCH, (step + 1) * BATCH)
        agree = agree + (a[live, cols] == b[live, cols]).sum(1)
        keep = agree >= least
        live, agree = live[keep], agree[keep]
    return live


def sizes_allow(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)


def prune(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (id, other) whose signatures leave the threshold plausible; other may be the same for many."""
    x = reps.select("id", F.col("n_shingles").alias("n"), F.col("sig").alias("s"))
    y = reps.select(F.col("id").alias("other"), F.col("n_shingles").alias("m"), F.col("sig").alias("t"))
    both = C.salted_join(pairs, y, "other").join(x, "id").filter(DEN * F.least("n", "m") >= NUM * F.greatest("n", "m"))

    def run(batch):
        keep = plausible(signatures(batch.column("s")), signatures(batch.column("t")))
        yield batch.select(["id", "other"]).take(pa.array(keep))

    return C.map_batches(both.select("id", "other", "s", "t"), run, "id long, other long")


def shingle_set(text: str) -> set:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(SHINGLE)), strict=False))


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold; texts has (id, text)."""
    pairs = C.materialise(pairs)
    counts = pairs.groupBy("other").agg(F.count(F.lit(1)).alias("n"))
    both = C.salted_join(pairs.join(texts.withColumnRenamed("text", "text_a"), "id"), texts.select(F.col("id").alias("other"), F.col("text").alias("text_b")), "other", counts=counts)

    def run(batch):
        held, sets, keep = None, set(), []
        for i in range(len(batch)):
            if (other := batch.column("other")[i].as_py()) != held:
                held, sets = other, shingle_set(batch.column("text_b")[i].as_py())
            own = shingle_set(batch.column("text_a")[i].as_py())
            common = len(own & sets)
            if DEN * common >= NUM * (len(own) + len(sets) - common) and common:
                keep.append(i)
        yield batch.select(["id", "other"]).take(pa.array(keep, pa.int64()))

    return C.materialise(C.map_batches(both.select("id", "other", "text_a", "text_b"), run, "id long, other long"))


class Forest:
    """Union-find over the components of one group."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def block_pairs(members: DataFrame, reps: DataFrame, block: int, best: int, texts: DataFrame | None = None) -> DataFrame:
    """Pairs (id, other) of different components within each bucket, block by block.

    members: (bucket, id, comp). A bucket of n rows is cut into ceil(n / block) blocks by a hash of the
    id, and each pair of blocks is one group of at most about 2 * block rows. A pair is looked at in the
    first band that it shares only. With best: the so many most alike plausible partners of each row.
    Else every plausible pair is compared on its shingle hashes, and the links that join components are
    returned; texts has (id, text).
    """
    count = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = C.salted_join(members, count, "bucket").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "id", "comp")
    rows = rows.join(reps.select("id", "n_shingles", "sig"), "id")
    if exact := texts is not None:
        rows = rows.join(texts, "id")

    def run(table: pa.Table) -> pa.Table:
        sig, ids = signatures(table.column("sig")), table.column("id").to_numpy()
        comp, n, mine = (table.column(c).to_numpy() for c in ("comp", "n_shingles", "mine"))
        i, j, band = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("bucket")[0].as_py() % BANDS
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        parts = sig.view(np.uint64)
        sets: dict[int, np.ndarray] = {}
        forest, found = Forest(), [np.zeros((0, 2), np.int64)]
        if exact:
            buf, offs = C.text_bytes(table.column("text"))
            for lo, hi in C.pieces(offs):
                row, sh = shingles(buf, offs[lo : hi + 1])
                edges = np.searchsorted(row, np.arange(hi - lo + 1))
                sets.update({lo + k: np.unique(sh[edges[k] : edges[k + 1]]) for k in range(hi - lo)})
        sides = [(left, right)] if i == j or not best else [(left, right), (right, left)]
        for own, others in sides:
            for x in own:
                y = others[others != x] if best else others[others > x] if i == j else others
                y = y[(comp[y] != comp[x]) & sizes_allow(n[y], n[x])]
                if band and len(y):
                    y = y[~(parts[y, :band] == parts[x, :band]).any(1)]
                if len(y):
                    y = y[plausible(np.broadcast_to(sig[x], (len(y), PERMUTATIONS)), sig[y])]
                if best:
                    y = y[np.argsort((sig[y] != sig[x]).sum(1), kind="stable")[:best]]
                    found.append(np.column_stack([np.full(len(y), ids[x]), ids[y]]))
                    continue
                for z in y:
                    if forest.root(comp[x]) != forest.root(comp[z]):
                        common = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                        if DEN * common >= NUM * (len(sets[x]) + len(sets[z]) - common):
                            forest.join(comp[x], comp[z])
                            found.append(np.array([[ids[x], ids[z]]]))
        pairs = np.concatenate(found)
        return pa.table({"id": np.maximum(pairs[:, 0], pairs[:, 1]), "other": np.minimum(pairs[:, 0], pairs[:, 1])})

    # dealt over a stated number of partitions, as rows are few for the work on them and would be put together
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(run, "id long, other long").distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row with an id.

    Null and blank texts have no shingles and stand alone. Repeated rows give repeated rows. Ids are
    integers; rows without an id have no component and are kept. An empty table gives an empty table.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = C.materialise(sign(docs, "id", "text"))
    some = signed.filter("words is not null and id is not null")
    classes = C.materialise(some.groupBy("words").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    first = classes.select(F.col("rep").alias("id"))
    reps = C.materialise(some.join(first, "id", "left_semi").dropDuplicates(["id"]).select("id", "n_shingles", "sig"))

    banded = bands(reps)
    buckets = C.materialise(banded.groupBy("bucket").agg(F.min("id").alias("other"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    sizes = buckets.select("bucket", "n")
    members = C.materialise(C.salted_join(banded, buckets.select("bucket", "other"), "bucket", counts=sizes))
    stars = C.materialise(members.filter("id <> other").select("id", "other").distinct())
    # merged at every size: the hint keeps the plan from turning with the number of members
    shared = members.select("id").distinct().hint("merge")
    texts = C.materialise(docs.filter("id is not null").join(shared, "id", "left_semi"))
    links = verify(prune(stars, reps), texts)
    comps = C.materialise(connected_components(links, "id", "other"))

    def open_buckets() -> DataFrame:
        """The members of the buckets that one component doesn't cover."""
        placed = members.select("bucket", "id").join(comps.withColumnRenamed("node", "id"), "id", "left")
        placed = C.materialise(placed.withColumn("comp", F.coalesce("component", "id")).select("bucket", "id", "comp"))
        several = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        return C.materialise(C.salted_join(placed, several.select("bucket"), "bucket", counts=sizes))

    # each row's most alike partners first, as their links leave few components apart
    near = C.materialise(block_pairs(open_buckets(), reps, block, BEST))
    links = links.unionByName(verify(near.join(stars, ["id", "other"], "left_anti"), texts))
    comps = C.materialise(connected_components(links, "id", "other"))
    # then all plausible pairs that are left; every row that has one is in near
    paired = near.select("id").union(near.select("other")).distinct()
    rest = open_buckets().join(paired, "id", "left_semi")
    left = C.materialise(block_pairs(rest, reps, block, 0, texts))
    if not left.isEmpty():
        links = links.unionByName(verify(left, texts))
        comps = C.materialise(connected_components(links, "id", "other"))

    found = classes.filter("copies > 1").select("words", "rep")
    out = signed.select("id", "n_shingles", "words").join(found, "words", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = out.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = out.withColumn("component_id", F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay: one document of each group, that of the smallest id.

    Each row is judged by its own text: where an id has several texts, each of them is a document of its own. Rows
    of one id and one text share their fate (exact dedup takes those); rows without an id and rows without words
    stay. An empty table gives an empty table. Any column names may stand beside.
    """
    name, gone, sha = (C.private(df, n) for n in ("drop", "drop_sha", "sha"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    texts = docs.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).groupBy("id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    if texts.filter("lo <> hi").isEmpty():
        drop = near_groups(df, id_col, text_col).filter("not kept").select(F.col(id_col).cast("long").alias(name)).distinct()
        return df.join(drop, F.col(id_col) == F.col(name), "left_anti")
    # documents are numbered in the order of their ids, so that the smallest number of a group is of its smallest id
    docs = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    once = docs.dropDuplicates(["id", "sha"]).repartitionByRange("id", "sha").sortWithinPartitions("id", "sha")
    once = C.materialise(once.withColumn("number", F.monotonically_increasing_id()))
    lost = near_groups(once, "number", "text").filter("not kept").select("number").join(once, "number")
    lost = lost.select(F.col("id").alias(name), F.col("sha").alias(gone))
    rows = df.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return rows.join(lost, (F.col(id_col) == F.col(name)) & (F.col(sha) == F.col(gone)), "left_anti").drop(sha)
