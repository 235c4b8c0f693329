"""Operator 12: the solver against a dense one, the query's columns against numpy, odd rows."""

import numpy as np
import pytest

from foliate.llm import whitening as W


@pytest.mark.parametrize("d,k", [(64, 32), (64, 64), (120, 8), (20, 32), (3, 2), (1, 1)])
def test_eigenpairs(d, k):
    b = np.random.default_rng(d).standard_normal((d, d)) * np.geomspace(1, 0.05, d)
    a = b @ b.T
    value, q, size = W.eigenpairs(lambda z: a @ z, d, k)
    expected = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.allclose(value, expected, rtol=0, atol=1e-13 * expected[0] * d)
    assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-12
    assert (size <= W.LEVEL * expected[0] * np.sqrt(d)).all()


def test_equal_values():
    value, _, size = W.eigenpairs(lambda z: np.diag([3.0, 3, 3, 1, 1, 0, 0, 0]) @ z, 8, 5)
    assert np.allclose(value, [3, 3, 3, 1, 1]) and size.max() < 1e-12


def test_minres():
    rng = np.random.default_rng(1)
    b = rng.standard_normal((30, 30))
    a, basis = b + b.T, np.linalg.qr(rng.standard_normal((30, 4)))[0]
    p = np.eye(30) - basis @ basis.T
    theta, right = np.array([0.3, -2.0]), p @ rng.standard_normal((30, 2))
    t = W.minres(lambda z: a @ z, theta, basis, right, 60, 1e-12)
    for j in range(2):
        assert np.abs(p @ (a @ t[:, j] - theta[j] * t[:, j]) - right[:, j]).max() < 1e-8


def table(spark, vectors):
    rows = [(i, v, "x", 7) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, data string, width int").repartition(3)


def test_brute(spark):
    rng = np.random.default_rng(3)
    fine = [rng.standard_normal(40).astype(np.float32).tolist() for _ in range(300)] + [[0.5] * 40] * 100
    odd = [None, [], [1.0] * 39, [None] + [1.0] * 39, [float("nan")] + [0.0] * 39, [float("inf")] + [0.0] * 39, [3e38] + [0.0] * 39]
    got = W.whitened(table(spark, fine + odd)).toPandas()
    x = np.floor(64 * np.array(fine, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    value, u = np.linalg.eigh(y.T @ y / n)
    value, u = value[::-1][:32], u[:, ::-1][:, :32]
    assert len(got) == n * 32 and set(got.n) == {n} and got.identity_error.max() < 1e-10
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    expected = y @ u / np.sqrt(value)
    assert np.abs(w * np.sign((w * expected).sum(0)) - expected).max() < 1e-8
    assert np.allclose(got.groupby("component").explained.first(), value / np.trace(y.T @ y / n), rtol=1e-10)
    assert (got.groupby("vec_id").deviation.first().to_numpy() == ((n * x - sums) ** 2).sum(1)).all()


def test_degenerate(spark):
    assert W.whitened(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert W.whitened(table(spark, [[1.0, 2.0]])).count() == 0
    assert W.whitened(table(spark, [None, []])).count() == 0
    assert W.whitened(table(spark, [[1.0]]).limit(0)).count() == 0
    line = W.whitened(table(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)]))
    assert {r.component for r in line.collect()} == {1} and line.count() == 9


def test_large_values(spark):
    got = W.whitened(table(spark, [[2.0**55, 1.0], [-(2.0**55), 2.0], [0.0, 3.0]]))
    assert {r.deviation for r in got.collect()} == {None} | {r.deviation for r in got.filter("deviation is not null").collect()}
    assert got.filter("component = 1").count() == 3
