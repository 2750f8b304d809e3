"""Reductions of wide vectors, by their numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import reduce as R


def frame(spark, x, y=None, w=None):
    rows = [(p.tolist(), *([q.tolist()] if y is not None else []), *([float(v)] if w is not None else [])) for p, q, v in zip(x, x if y is None else y, np.ones(len(x)) if w is None else w, strict=True)]
    return spark.createDataFrame(rows, "x array<double>" + (", y array<double>" if y is not None else "") + (", weight double" if w is not None else "")).repartition(5)


def test_sketch_finds_the_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 40)) @ np.diag(1.6 ** -np.arange(40)) @ np.linalg.qr(rng.normal(size=(40, 40)))[0] + 3
    df = frame(spark, x)
    got, want = R.sketched_pca(df, "x", 4, 6), R.pca(df, "x", dims=4)
    assert got.spectrum == pytest.approx(want.spectrum, rel=1e-7)
    assert got.directions == pytest.approx(want.directions, abs=1e-4)
    assert got.mean == pytest.approx(want.mean)
    with pytest.raises(ArithmeticError):
        R.sketched_pca(df, "x", 4, 6, most=1)


def test_wide_vectors(spark):
    """1,881 coordinates: no row of the sums is longer than a block, and the projection holds no literals."""
    rng = np.random.default_rng(2)
    x = np.outer(rng.normal(size=60) * 5, rng.normal(size=1881)) + 0.01 * rng.normal(size=(60, 1881))
    df = frame(spark, x)
    found = R.sketched_pca(df, "x", 2)
    c = x - x.mean(axis=0)
    values = np.linalg.svd(c, compute_uv=False) ** 2 / len(x)
    assert found.spectrum[0] == pytest.approx(values[0], rel=1e-6)
    out = df.select(found.column(F.col("x")).alias("v"))
    assert len(out._jdf.queryExecution().toString()) < 5000
    assert np.sort([r.v[0] for r in out.collect()]) == pytest.approx(np.sort(c @ found.directions[:, 0]), abs=1e-6)


def test_nulls_do_not_count(spark):
    rows = [([1.0, 2.0],), (None,), ([1.0, None],), ([3.0, 2.5],), ([4.0, 0.0],)]
    df = spark.createDataFrame(rows, "x array<double>")
    x = np.array([[1, 2], [3, 2.5], [4, 0]])
    found = R.pca(df, "x", dims=1)
    assert found.mean == pytest.approx(x.mean(axis=0))
    assert R.sketched_pca(df, "x", 1).mean == pytest.approx(x.mean(axis=0))
    got = [r.v for r in df.where("x is null or not exists(x, v -> v is null)").select(found.column(F.col("x")).alias("v")).collect()]
    assert got[1] is None and [g[0] for g in got if g] == pytest.approx(list(((x - x.mean(axis=0)) @ found.directions)[:, 0]))


def test_numbers_of_tica_and_vamp(spark):
    rng = np.random.default_rng(5)
    n, d = 400, 3
    z = np.zeros((n + 1, d))
    for i in range(n):
        z[i + 1] = np.array([0.95, 0.7, 0.2]) * z[i] + rng.normal(size=d)
    mix = rng.normal(size=(d, d))
    x, y, w = z[:-1] @ mix, z[1:] @ mix, rng.random(n) + 0.5
    # Independent components as a generalised eigenproblem, by a solve and not by whitening.
    p = w / w.sum()
    mean = (p @ x + p @ y) / 2
    cov = lambda a, b: (p[:, None] * (a - mean)).T @ (b - mean)
    c0 = (cov(x, x) + cov(y, y)) / 2
    ct = (cov(x, y) + cov(y, x)) / 2
    want = np.sort(np.linalg.eigvals(np.linalg.solve(c0, ct)).real)[::-1]
    found = R.tica(frame(spark, x, y, w), 1.0, kinetic_map=False)
    assert found.spectrum[: len(want)] == pytest.approx(want[np.argsort(-np.abs(want))][: len(found.spectrum)], rel=1e-6)
    v = found.directions
    assert v.T @ c0 @ v == pytest.approx(np.eye(v.shape[1]), abs=1e-8)
    # Singular values of the propagator: those of the cross-covariance between inverse roots.
    mx, my = x - x.mean(axis=0), y - y.mean(axis=0)
    root = lambda c: np.linalg.inv(np.linalg.cholesky(c))
    s = np.linalg.svd(root(mx.T @ mx / n) @ (mx.T @ my / n) @ root(my.T @ my / n).T, compute_uv=False)
    assert R.vamp(frame(spark, x, y)).spectrum == pytest.approx(s, rel=1e-6)


def test_close_variances_take_few_passes(spark, monkeypatch):
    """Nearly equal variances: once the directions span all coordinates, the components are exact."""
    x = np.random.default_rng(8).standard_normal((3000, 16))
    df = frame(spark, x)
    passes = []
    real = R._added
    monkeypatch.setattr(R, "_added", lambda parts: passes.append(1) or real(parts))
    got = R.sketched_pca(df, "x", 2, 3, most=200, tol=1e-11)
    assert len(passes) <= 4
    want = R.pca(df, "x", dims=2)
    assert np.allclose(got.directions, want.directions, atol=1e-9) and np.allclose(got.spectrum, want.spectrum)


def test_sketch_goes_on_from_its_best_block(spark, monkeypatch):
    monkeypatch.setattr(R, "SPAN", 2)
    x = np.random.default_rng(9).standard_normal((2000, 30)) * np.linspace(1, 2, 30)
    got, want = R.sketched_pca(frame(spark, x), "x", 2, 3, most=60, tol=1e-12), R.pca(frame(spark, x), "x", dims=2)
    assert np.allclose(got.spectrum, want.spectrum) and np.allclose(got.directions, want.directions, atol=1e-5)


def test_sketch_of_few_different_vectors(spark):
    x = np.outer([1.0, 2.0, 4.0, 4.0], np.arange(8.0))
    got = R.sketched_pca(frame(spark, x), "x", 3, 2)
    assert np.allclose(got.spectrum, [R.pca(frame(spark, x), "x", dims=1).spectrum[0], 0, 0])
