"""Embedding whitening by QDWH spectral divide and conquer.

1. Entries become integers, so sums and second moments are exact at any number of rows: partial sums of each
   task are added by Spark as decimals. Moments are centred at the integers next to the means before entries are
   multiplied; what is left of the centring is done in whole numbers.
2. The covariance (dimension x dimension, whatever the number of rows) is split on the driver: the polar factor of
   the covariance less a shift is the sign of each eigenvalue's distance from the shift, (factor + identity) / 2
   projects on the eigenvectors above it, and both invariant subspaces are split again until single components
   are left.
3. Components are broadcast, and every row is centred, projected and scaled.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

#: x = floor(SCALE * c) + SHIFT; components of a row at most.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows whose products are summed in doubles, without rounding while centred entries are at most EXACT; entries beyond LARGEST count as not finite.
CHUNK, EXACT, LARGEST = 2048, 1 << 21, 1 << 46
#: Components with less than this share of the largest eigenvalue, times the dimension, have no variance.
FLAT = 1e-14
EPS = np.finfo(float).eps


def integers(column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that remain, and their entries x; all vectors have dims entries unless that is None, then one vector is given."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dims)
    if not len(rows) or not dims:
        return rows[:0], np.zeros((0, dims or 0), np.int64)
    flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
    c = np.asarray(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)).reshape(len(rows), dims)
    good = (np.isfinite(c) & (np.abs(c) <= LARGEST / SCALE)).all(1)
    return rows[good], np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def usual_length(df: DataFrame) -> int:
    """The length that most vectors have, the longer of two as frequent; 0 if there is none."""
    sizes = df.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("d > 0")
    top = sizes.agg(F.max(F.struct("n", "d")).alias("top")).first().top
    return top.d if top else 0


def _added(df: DataFrame, width: int) -> list[list]:
    """Rows (i, v) added up by i, entry by entry."""
    sums = [F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(width)]
    return [list(r)[1:] for r in df.groupBy("i").agg(*sums).orderBy("i").collect()]


def _exactly(rows: list) -> pa.Array:
    return pa.array([[Decimal(int(x)) for x in row] for row in rows], pa.list_(pa.decimal128(38, 0)))


def sums(df: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors that remain, and the sum of x in each dimension."""

    def run(batches):
        n, total = 0, [0] * dims
        for batch in batches:
            _, x = integers(batch.column("vector"), dims)
            n, total = n + len(x), [t + int(s) for t, s in zip(total, x.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), _exactly([[n, *total]])], names=["i", "v"])

    got = _added(df.mapInArrow(run, "i int, v array<decimal(38,0)>"), dims + 1)
    return (int(got[0][0]), [int(x) for x in got[0][1:]]) if got else (0, [0] * dims)


def moments(df: DataFrame, dims: int, centre: np.ndarray) -> list[list[int]]:
    """Sums of the products of x - centre, exact."""

    def run(batches):
        total = np.zeros((dims, dims), object)
        for batch in batches:
            _, x = integers(batch.column("vector"), dims)
            for at in range(0, len(x), CHUNK):
                z = x[at : at + CHUNK] - centre
                if np.abs(z).max() <= EXACT:
                    z = z.astype(np.float64)
                    total = total + (z.T @ z).astype(np.int64).astype(object)
                else:
                    z = z.astype(object)
                    total = total + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), _exactly(total.tolist())], names=["i", "v"])

    return [[int(x) for x in row] for row in _added(df.mapInArrow(run, "i int, v array<decimal(38,0)>"), dims)]


def covariance(n: int, total: list[int], products: list[list[int]]) -> np.ndarray:
    """Covariance of centred integers with these sums, each entry rounded once."""
    return np.array([[float(Fraction(n * p - a * b, n * n)) for p, b in zip(row, total, strict=True)] for row, a in zip(products, total, strict=True)])


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations."""
    size = len(a)
    x = a / np.linalg.norm(a)
    least = np.abs(np.diag(np.linalg.qr(x, mode="r"))).min() / np.sqrt(size)
    low, eye = max(min(least, 1.0), EPS), np.eye(size)
    for _ in range(60):
        # the weights that lift the smallest singular value most
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if moved <= np.cbrt(EPS) and abs(1 - low) < 10 * EPS or moved <= size * EPS:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Orthonormal bases of the eigenvectors above and below shift, and how far they are from invariant."""
    size = len(a)
    projector = (polar_factor(a - shift * np.eye(size)) + np.eye(size)) / 2
    k = int(round(float(np.trace(projector))))
    if not 0 < k < size:
        return np.zeros((size, 0)), np.zeros((size, 0)), np.inf
    basis = projector @ np.random.default_rng(size).standard_normal((size, k))
    for _ in range(2):
        basis = projector @ np.linalg.qr(basis)[0]
    whole, _ = np.linalg.qr(basis, mode="complete")
    return whole[:, :k], whole[:, k:], float(np.linalg.norm(whole[:, :k].T @ a @ whole[:, k:]))


def spectrum(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, eigenvalues falling; equal ones take any basis."""
    size, a = len(a), (a + a.T) / 2
    scale = np.linalg.norm(a) if scale is None else scale
    diagonal = np.diag(a)
    if size == 1 or np.linalg.norm(a - np.diag(diagonal)) <= size * EPS * scale / 8:
        order = np.argsort(-diagonal, kind="stable")
        return diagonal[order], np.eye(size)[:, order]
    mean, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(size)) / np.sqrt(size)
    best = None
    # the mean lies between eigenvalues; a shift that comes too near to one is moved
    for shift in (np.median(diagonal), mean, *(mean + f * spread for f in (0.11, -0.13, 0.29, -0.31, 0.47, -0.53, 0.71, -0.79))):
        above, below, rest = _split(a, shift)
        if best is None or rest < best[2]:
            best = (above, below, rest)
        if rest <= 8 * size * EPS * scale:
            break
    above, below, rest = best
    if not np.isfinite(rest):
        order = np.argsort(-diagonal, kind="stable")
        return diagonal[order], np.eye(size)[:, order]
    parts = [(e, basis @ v) for basis in (above, below) for e, v in (spectrum(basis.T @ a @ basis, scale),)]
    values, vectors = np.concatenate([p[0] for p in parts]), np.hstack([p[1] for p in parts])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues and eigenvectors, the largest entry of each vector positive; values without variance are zero."""
    values, vectors = spectrum(cov)
    values, vectors = values[:most], vectors[:, :most]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return np.where(values > FLAT * len(cov) * max(values[0], 0.0), values, 0.0), vectors


def _whitened(x: np.ndarray, fit: dict) -> np.ndarray:
    """Rows centred, projected and scaled; NaN for components without variance."""
    flat = fit["values"] <= 0
    out = ((x - fit["centre"]) - fit["rest"]) @ fit["vectors"] / np.sqrt(np.where(flat, 1.0, fit["values"]))
    out[:, flat] = np.nan
    return out


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums of (n * x - total)^2, exact; null where 64 bits don't hold one."""
    most = n * int(np.abs(x).max()) + max(map(abs, total)) if len(x) else 0
    if most < 1 << 62:
        far = n * x - np.array(total, np.int64)
        if far.shape[1] * int(np.abs(far).max(initial=0)) ** 2 < 1 << 63:
            return (far * far).sum(1).tolist()
    far = n * x.astype(object) - np.array(total, object)
    return [s if s < 1 << 63 else None for s in (far * far).sum(1).tolist()]


def _identity_error(df: DataFrame, fit: dict, n: int) -> float:
    """Largest absolute entry of the covariance of all whitened rows less the identity."""
    dims, live = len(fit["centre"]), np.flatnonzero(fit["values"] > 0)
    k = len(live)
    if not k:
        return 0.0

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = _whitened(integers(batch.column("vector"), dims)[1], fit)[:, live]
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    got = np.array(_added(df.mapInArrow(run, "i int, v array<double>"), k))
    mean = got[k] / n
    return float(np.abs(got[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row that remains and component.

    Rows go whose vector is null, empty, of another length than most, or holds entries that are null, not finite or
    beyond 2^36. Repeated rows, and rows without an id, are rows like others. There are as many components as
    dimensions, at most `most`. A component without variance (one row, equal rows, dependent dimensions) has a null
    whitened and counts in no identity_error. A deviation that 64 bits don't hold is null. Eigenvectors of equal
    eigenvalues are any basis of their space. An empty table, or one without a vector that remains, gives an empty
    table. Other columns are not looked at.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = usual_length(rows)
    n, total = sums(rows, dims) if dims else (0, [])
    if not n:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    centre = np.array([round(Fraction(s, n)) for s in total], np.int64)
    left = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    cov = covariance(n, left, moments(rows, dims, centre))
    values, vectors = components(cov, min(most, dims))
    trace = float(np.trace(cov))
    fit = {"centre": centre, "rest": np.array([float(Fraction(s, n)) for s in left]), "values": values, "vectors": vectors}
    error = _identity_error(rows, fit, n)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    k = len(values)

    def run(batch):
        at, x = integers(batch.column("vector"), dims)
        ids = batch.column("id").take(pa.array(np.repeat(at, k)))
        w = _whitened(x, fit).ravel()
        yield pa.RecordBatch.from_arrays(
            [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(w), n)),
                pa.array(_deviations(x, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, len(at))), pa.array(np.full(len(w), error)),
            ],
            names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )

    return C.map_batches(rows, run, schema).withColumnRenamed("id", id_col)
