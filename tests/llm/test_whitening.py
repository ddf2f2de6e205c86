"""Whitening against numpy's eigenvectors and exact integer sums."""

import math

import numpy as np
import pytest
from pyspark.sql import Row

from tessera.llm import whitening

VEC = "vec_id long, embedding array<double>, n long"


def table(spark, vectors, kind=VEC):
    return spark.createDataFrame([(i, v, 7) for i, v in enumerate(vectors)], kind).repartition(3)


def brute(vectors):
    """n, exact deviations, projections by numpy.linalg.eigh and shares of variance."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x], z @ v, e


def assert_equal(rows, vectors, most=8):
    n, deviation, projected, e = brute(vectors)
    k = min(most, len(vectors[0]))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * k
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in range(n)])
        wanted = projected[:, c] / np.sqrt(e[c])
        assert min(np.abs(mine - wanted).max(), np.abs(mine + wanted).max()) < 1e-8
        assert all(r.explained == pytest.approx(e[c] / e.sum(), rel=1e-9) for r in rows if r.component == c + 1)
    assert [got[i, 1].deviation for i in range(n)] == deviation
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-8


@pytest.mark.parametrize("dims", [1, 3, 20])
def test_whitened_rows_equal_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = (rng.standard_normal((120, dims)) @ rng.standard_normal((dims, dims))).tolist()
    assert_equal(whitening.whiten(table(spark, vectors)).collect(), vectors)


def test_spectrum_equals_the_library():
    rng = np.random.default_rng(5)
    half = rng.standard_normal((40, 40))
    near = np.diag(np.repeat([1.0, 2.0, 3.0], 10)) + 1e-3
    for a in (half @ half.T, half[:, :9] @ half[:, :9].T, near, np.eye(6) * 4, np.zeros((3, 3)), np.array([[2.0, 1.0], [1.0, 2.0]])):
        e, v = whitening.spectrum(a)
        size = max(np.linalg.norm(a), 1.0)
        assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size
        assert np.linalg.norm(a @ v - v * e) < 1e-13 * size and np.linalg.norm(v.T @ v - np.eye(len(a))) < 1e-12


def test_polar_factor_is_the_sign_of_the_eigenvalues():
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    e = np.array([1e-9, 1e-3, 0.5, 1, 3, 100, -1e-9, -1e-3, -0.5, -1, -3, -100])
    assert np.abs(whitening.polar_factor((q * e) @ q.T) - (q * np.sign(e)) @ q.T).max() < 1e-5


def test_rows_that_go_and_rows_that_stay(spark):
    good = [[0.5, -0.25, 1.0], [0.1, 0.2, 0.3], [0.1, 0.2, 0.3], [-3.0, 2.0, 0.0], [9.0, 1.0, -1.0]]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    assert_equal(whitening.whiten(table(spark, good + bad)).collect(), good)
    rows = whitening.whiten(spark.createDataFrame([(None, v, 1) for v in good], VEC)).collect()
    assert len(rows) == 15 and all(r.vec_id is None for r in rows)
    for nothing in ([], bad[:3]):
        empty = whitening.whiten(table(spark, nothing))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance_and_large_entries(spark):
    for vectors in ([[1.0, 2.0]], [[1.0, 2.0]] * 4):
        rows = whitening.whiten(table(spark, vectors)).collect()
        assert len(rows) == 2 * len(vectors) and all((r.whitened, r.deviation, r.explained, r.identity_error) == (None, 0, 0.0, 0.0) for r in rows)
    rows = whitening.whiten(table(spark, [[1.0, 2.0], [2.0, 4.0], [4.0, 8.0]])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in rows) and rows[0].identity_error < 1e-9
    rows = whitening.whiten(table(spark, [[3e6, 0.0], [-3e6, 1.0], [1e6, -4.0]])).collect()
    assert {r.deviation for r in rows} == {None, *[d for d in brute([[3e6, 0.0], [-3e6, 1.0], [1e6, -4.0]])[1] if d < 1 << 63]}
    assert rows[0].identity_error < 1e-4


def test_floats_are_read_as_doubles(spark):
    values = [[0.1, 0.7], [0.30000001, -0.2], [0.9, 0.4]]
    rows = whitening.whiten(spark.createDataFrame([Row(vec_id=i, embedding=v) for i, v in enumerate(values)], "vec_id int, embedding array<float>")).collect()
    assert_equal(rows, np.array(values, np.float32).astype(float).tolist())
