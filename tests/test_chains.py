"""Chains on edge tables, block by block, against dense solves."""

import numpy as np
import pytest

from weftline.operators import chains as H
from weftline.operators import markov as M
from weftline.operators import optimize as O


def line(n, seed):
    """Steps to neighbours only: the slowest kind for its size."""
    rng = np.random.default_rng(seed)
    t = np.diag(0.2 + 0.3 * rng.random(n - 1), 1) + np.diag(0.2 + 0.3 * rng.random(n - 1), -1)
    return t + np.diag(1 - t.sum(axis=1))


def loose(n, seed):
    """A sparse random chain on one cycle, and states outside of its closed class."""
    rng = np.random.default_rng(seed)
    t = (rng.random((n, n)) < 5 / n) * rng.random((n, n))
    t[np.arange(n), (np.arange(n) + 1) % n] += 0.05
    t[:, -3:] = 0
    t[-4, 0] += 0.1
    t[-1, -2] = t[-2, -1] = 0.5
    return M.normalized_rows(t)


def values(df, name="value"):
    return {r["state"]: r[name] for r in df.collect()}


def frame(spark, states):
    return spark.createDataFrame([(int(s),) for s in states], "state long")


@pytest.mark.parametrize(("t", "options"), [(line(18, 1), {"block": 6}), (loose(30, 2), {"block": 10}), (loose(40, 3), {})])
def test_stationary(spark, t, options):
    got = values(H.stationary(M.matrix_frame(spark, t), tol=1e-12, **options))
    pi = M.steady_state(t)
    assert got.keys() == set(range(len(t)))
    assert max(abs(got[i] - pi[i]) for i in got) < 1e-8


def test_one_pass_where_one_block_holds_all(spark, monkeypatch):
    sweeps = []
    real = H._combined
    monkeypatch.setattr(H, "_combined", lambda *a, **b: sweeps.append(1) or real(*a, **b))
    H.stationary(M.matrix_frame(spark, line(20, 5)))
    assert not sweeps


@pytest.mark.parametrize(("t", "options"), [(line(18, 6), {"block": 6})])
def test_committor(spark, t, options):
    n = len(t)
    got = values(H.committor(M.matrix_frame(spark, t), frame(spark, [0, 1]), frame(spark, [n - 1]), **options))
    q = M.committor(t, [0, 1], [n - 1])
    assert max(abs(got[i] - q[i]) for i in range(n)) < 1e-8


def test_passage(spark):
    t = loose(30, 8)
    got = values(H.mean_passage(M.matrix_frame(spark, t), frame(spark, [29]), block=12))
    want = np.linalg.solve(np.eye(1) - t[28:29, 28:29], np.ones(1))
    assert got[29] == 0 and abs(got[28] - want[0]) < 1e-9
    assert all(np.isinf(got[i]) == (i < 27) for i in range(27))


def test_poisson(spark):
    t = line(15, 9)
    pi = M.steady_state(t)
    h, v = O.discrepancy(t, pi, 14)
    rows = {r.state: r for r in H.poisson(M.matrix_frame(spark, t), frame(spark, [14]), block=8).collect()}
    assert max(abs(rows[i].h - h[i]) for i in range(15)) < 1e-8 * np.abs(h).max()
    assert max(abs(rows[i].v - v[i]) for i in range(15)) < 1e-6
    assert max(abs(rows[i].pi - pi[i]) for i in range(15)) < 1e-10


@pytest.mark.parametrize("every", [3, 8])
def test_passage_distribution(spark, every):
    t = loose(14, 10)
    starts = np.zeros((2, 14))
    starts[0, 0], starts[1, [2, 5]] = 1.0, (0.25, 0.75)
    rows = [(k, i, float(starts[k, i])) for k in range(2) for i in np.flatnonzero(starts[k]).tolist()]
    got = {(r.source, r.step): r.p for r in H.passage_distribution(M.matrix_frame(spark, t), spark.createDataFrame(rows, "source int, state int, value double"), frame(spark, [5, 7]), 11, every).collect()}
    v, off = starts, t.copy()
    want = {}
    for k in range(1, 12):
        v = v @ off
        for s in range(2):
            if v[s, [5, 7]].sum() > 0:
                want[s, k] = v[s, [5, 7]].sum()
        v[:, [5, 7]] = 0
    assert got == pytest.approx(want, abs=1e-12)


def test_walks_that_have_all_arrived_end_the_search(spark):
    t = np.array([[0, 1.0, 0], [0, 0, 1.0], [1.0, 0, 0]])
    starts = spark.createDataFrame([(1, 0, 1.0)], "source int, state int, value double")
    assert H.passage_distribution(M.matrix_frame(spark, t), starts, frame(spark, [2]), 500, 2).collect() == [(1, 2, 1.0)]


def test_refuses_to_return_what_has_not_settled(spark):
    with pytest.raises(H.NotConverged):
        H.stationary(M.matrix_frame(spark, line(30, 1)), block=8, most=2)
    with pytest.raises(H.NotConverged):
        H.committor(M.matrix_frame(spark, line(30, 1)), frame(spark, [0]), frame(spark, [29]), block=8, most=2)


def test_blocks_of_blocks(spark):
    """More blocks than the driver takes: the chain of blocks is dealt to blocks itself."""
    t = loose(14, 7)
    got = values(H.stationary(M.matrix_frame(spark, t), block=4, local=2, tol=1e-4))
    assert max(abs(got[i] - x) for i, x in enumerate(M.steady_state(t))) < 1e-3


def test_edges_of_nothing(spark):
    none = spark.createDataFrame([], "from_state long, to_state long, p double")
    assert H.stationary(none).count() == 0
    with pytest.raises(ValueError):
        H.solved(none, spark.createDataFrame([], "state long, value double"))
    assert values(H.solved(none, spark.createDataFrame([(3, 0.5)], "state long, value double"))) == {3: 0.5}
