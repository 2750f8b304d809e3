"""Laws that solved chains and reductions must obey, and plan shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import cluster as C
from weftline.operators import flux as X
from weftline.operators import graphs as G
from weftline.operators import markov as M
from weftline.operators import optimize as O
from weftline.operators import passage as Q
from weftline.operators import reduce as R
from weftline.operators import trajectories as T
from weftline.sources import segments as S


@pytest.fixture(scope="module")
def chain():
    t = M.random_markov_matrix(7, 3)
    t[6] = 0
    t[6, 5] = 1
    return t


def test_steady_states(chain):
    pi = M.steady_state(chain)
    assert pi @ chain == pytest.approx(pi)
    for other in (M.steady_state_algebraic(chain), M.steady_state_powers(chain, 1e-12), M.inverse_iteration(chain)):
        assert other == pytest.approx(pi, abs=1e-6)


def test_committors(chain):
    q = M.committor(chain, [5], [6])
    assert (q[5], q[6]) == (0, 1)
    assert ((q >= 0) & (q <= 1)).all()
    assert M.committor_steps(chain, 5, 6) == pytest.approx(q, abs=1e-4)
    back = M.backward_committor(chain, M.steady_state(chain), [5], [6])
    assert (back[5], back[6]) == (1, 0)


def test_flux_is_one_over_mfpt(chain):
    j = M.flux_into(chain, M.steady_state(chain), 5, 6)
    cycle = Q.directional_mfpt(chain, [5], [6])
    assert 1 / j == pytest.approx(cycle + 1)


def test_profile_is_what_crosses(spark, chain):
    w = M.steady_state(chain)[:, None] * chain + np.diag(np.full(6, 0.1), 1)
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(7) for j in range(7)], "from_state bigint, to_state bigint, w double")
    places = spark.createDataFrame([(i, i) for i in range(7)], "state bigint, place bigint")
    got = {r["place"]: r["flux"] for r in X.profile(edges, places).collect()}
    for k in range(7):
        out, inn = w[: k + 1, k + 1 :].sum(), w[k + 1 :, : k + 1].sum()
        assert got[k] == pytest.approx(inn - out, abs=1e-12)
    assert got[6] == pytest.approx(0, abs=1e-12)


def test_components_and_cleaning():
    m = np.zeros((6, 6))
    for a, b in [(0, 1), (1, 0), (1, 2), (3, 4), (4, 5), (5, 3)]:
        m[a, b] = 1
    assert G.strong_components(m) == [[3, 4, 5], [0, 1], [2]]
    assert G.strong_components(m, directed=False) == [[0, 1, 2], [3, 4, 5]]
    assert G.reaches(m, [0], [1, 2])
    assert not G.reaches(m, [2], [0])
    t, stay = M.cleaned(m)
    assert stay == [0, 1, 3, 4, 5]
    assert M.check_rows(t)


def test_lifted_rows(chain):
    t2 = M.lifted_matrix(chain, [5], [6])
    assert M.check_rows(t2)


def test_fundamental_sequence():
    t = np.array([[0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.5, 0.5, 0.0]])
    assert G.fundamental_sequence([0, 1, 0, 2], t) == [0, 2]
    assert G.fundamental_sequence([0, 1, 2], t) == [0, 1, 2]


def test_discrepancy(chain):
    pi = M.steady_state(chain)
    h, v = O.discrepancy(chain, pi, 6)
    assert h @ pi == pytest.approx(0, abs=1e-9)
    assert (v >= 0).all()
    b = O.clustered_bins(h[:-2], v[:-2], pi[:-2], 5)
    assert set(b) == {0, 1, 2}


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(0).normal(size=(200, 4)) @ np.diag([3, 2, 1, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i bigint, x array<double>")
    red = R.pca(df, "x", 0.95)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert red.spectrum == pytest.approx((s**2 / len(x))[: len(red.spectrum)])
    got = np.array([r[0] for r in df.orderBy("i").select(red.column(F.col("x"))).collect()])
    assert np.abs(got) == pytest.approx(np.abs((x - x.mean(axis=0)) @ vt[: got.shape[1]].T))


def test_kmeans_is_reproducible(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 2, (rng.normal(size=2) + 10 * (i % 3)).tolist(), 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "bin bigint, x array<double>, weight double")
    key = lambda d: sorted((r["bin"], r["local_id"], tuple(np.round(r["x"], 9))) for r in d.collect())
    assert key(C.stratified_centres(df, 3, 5)) == key(C.stratified_centres(df.repartition(7), 3, 5))
    got = C.assigned(df, C.numbered(C.stratified_centres(df, 3, 5)))
    assert got.where("state is null").count() == 0
    near = C.nearest(df.withColumn("id", F.monotonically_increasing_id()), C.numbered(C.stratified_centres(df, 3, 5)), ["id"], ["bin"])
    assert sorted(r["state"] for r in near.collect()) == sorted(r["state"] for r in got.collect())


def test_partitions_do_not_matter(spark):
    rows = [(t, i, float((t * 31 + i * 17) % 100)) for t in range(20) for i in range(50)]
    df = spark.createDataFrame(rows, "traj bigint, idx bigint, x double")
    found = lambda d: sorted(map(tuple, T.passages(d, F.col("x") < 10, F.col("x") > 90).collect()))
    one = found(df.coalesce(1))
    assert one == found(df.repartition(9))
    parts = [found(df.where(F.col("traj") == t)) for t in range(20)]
    assert one == sorted(r for p in parts for r in p)


@pytest.mark.parametrize("block", [5, 16, 1000])
def test_blocks_do_not_matter(spark, block):
    """Operators over blocks of a trajectory give what windows over whole trajectories give."""
    rows = [(t, i, "abcd"[(t * 7 + i * i * 3 + i // 3) % 4]) for t in range(4) for i in range(60 - 7 * t)] + [(9, 0, "a"), (None, 0, "a"), (None, 1, "b")]
    df = spark.createDataFrame(rows, "traj bigint, idx bigint, state string").repartition(3)
    a, b = F.col("state") == "a", F.col("state") == "d"
    both = lambda f: [sorted(map(str, f(x).collect())) for x in (None, block)]
    for f in (
        lambda x: T.passages(df, a, b, block=x),
        lambda x: T.passages(df, a, b, 2, block=x),
        lambda x: T.paths(df, a, b, block=x),
        lambda x: T.count_pairs(df, 3, block=x),
        lambda x: T.count_pairs(df, 3, False, block=x),
        lambda x: T.coloured_counts(df, a, b, 3, block=x),
        lambda x: T.coloured_counts(df, a, b, 2, False, block=x),
        lambda x: T.history_counts(df, a, b, 2, 3, block=x),
        lambda x: T.correlation(df, a, b, [1, 2, 5], True, block=x),
    ):
        whole, parts = both(f)
        assert whole == parts
        assert whole


def test_numbering_by_buckets(spark):
    log = spark.createDataFrame([(i % 3, (i * 37) % 100, i) for i in range(90)], "who bigint, at bigint, id bigint")
    one = T.from_log(log, "who", ["at", "id"], x="id")
    many = T.from_log(log, "who", ["at", "id"], F.expr("at div 7"), x="id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_one_exchange_for_passages(spark):
    df = spark.createDataFrame([(t, i, t * i % 10 / 10) for t in range(5) for i in range(9)], "traj bigint, idx bigint, x double")
    plan = T.passages(df, F.col("x") < 0.1, F.col("x") > 0.9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_lagged_pairs_of_a_recycled_walker(spark):
    """The pair before the warp starts at what the ended history points to, with the weight at the warp."""
    rows = [(0, 1, 0, 0.5, 0, 1, [0.0], [1.0]), (0, 1, 1, 0.25, 0, 1, [0.5], [1.5]), (0, 2, 0, 0.5, 0, 1, [1.0], [2.0]), (0, 3, 0, 0.4, -1, 1, [7.0], [3.0]), (0, 4, 0, 0.3, 0, 1, [3.0], [4.0])]
    df = spark.createDataFrame(rows, "file_idx int, n_iter int, seg_id bigint, weight double, parent_id bigint, endpoint_type int, coord0 array<double>, coord1 array<double>")
    basis, reference = F.array(F.lit(9.0)), F.array(F.lit(8.0))
    got = sorted(map(tuple, S.lagged_pairs(df, 1, basis, reference).collect()))
    assert got == sorted([([0.0], [2.0], 0.5), ([9.0], [3.0], 0.4), ([1.0], [8.0], 0.4), ([7.0], [4.0], 0.3)])
    got = sorted(map(tuple, S.lagged_pairs(df, 2, basis, reference).collect()))
    assert got == sorted([([9.0], [3.0], 0.4), ([0.0], [8.0], 0.4), ([9.0], [4.0], 0.3), ([1.0], [8.0], 0.4)])


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("slope", [-2.0, 2.0])
def test_overcorrected_profile(spark, slope, before):
    """A profile is overcorrected if it is higher towards the target, on whichever side that lies."""
    points = spark.createDataFrame([(float(x), slope * x + 1) for x in range(5)], "x double, y double")
    assert X.fit_line(points, "x", "y", before).first()["overcorrected"] is ((slope < 0) if before else (slope > 0))


def test_unreachable_states():
    t = np.array([[0.5, 0.5, 0], [0.5, 0.5, 0], [0, 0, 1.0]])
    assert Q.mfpt_to(t, 1).tolist() == [2.0, 0.0, np.inf]
    t = np.array([[0.5, 0.25, 0.25], [0.5, 0.5, 0], [0, 0, 1.0]])
    assert Q.mfpt_to(t, 1).tolist() == [np.inf, 0.0, np.inf]


def test_fewer_iterations_than_blocks(spark):
    df = spark.createDataFrame([(i, 1.0) for i in (1, 2, 3)], "n_iter int, weight double")
    assert sorted((r["n_iter"], r["group_id"]) for r in X.block_groups(df, 3, 2, 4).collect()) == [(1, 0), (2, 1)]


def test_reductions_need_rows(spark):
    from weftline.operators import reduce as R

    df = spark.createDataFrame([], "x array<double>, y array<double>, weight double")
    for method in ("pca", "tica", "vamp"):
        with pytest.raises(ValueError, match="no rows"):
            R.reduction(method, df)


def test_wide_reductions_send_blocks(spark):
    """Moments of 150 dimensions come in blocks, and equal those of one matrix."""
    from weftline.operators import reduce as R

    rng = np.random.default_rng(0)
    x, y, w = rng.normal(size=(300, 150)), rng.normal(size=(300, 150)), rng.random(300)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), float(c)) for a, b, c in zip(x, y, w, strict=True)], "x array<double>, y array<double>, weight double").repartition(5)
    s = R._sums(df)
    assert s["xy"] == pytest.approx((w[:, None] * x).T @ y / w.sum())
    assert s["yy"] == pytest.approx((w[:, None] * y).T @ y / w.sum())
    assert s["y"] == pytest.approx(w @ y / w.sum())


def test_steady_flux_accumulates(chain):
    h, kh, varh = M.accumulated_flux(chain, [6], conv=1e-9)
    assert kh == pytest.approx(chain @ h)
    assert (varh > -1e-9).all()


def test_simulated_paths(spark, chain):
    paths = Q.simulate_paths(spark, chain, [0], [6], 50, seed=1).collect()
    assert len(paths) == 50
    assert all(r["path"][0] == 0 and r["path"][-1] == 6 and 6 not in r["path"][:-1] for r in paths)
    assert sorted(map(tuple, (r["path"] for r in paths))) == sorted(tuple(r["path"]) for r in Q.simulate_paths(spark, chain, [0], [6], 50, seed=1).repartition(3).collect())


@pytest.mark.parametrize("block", [3, 256])
def test_all_passage_times_from_one_factorisation(spark, block, monkeypatch):
    from weftline.operators import markov as M
    from weftline.operators import passage as Q

    t = M.random_markov_matrix(11, 3)
    t[2] = 0
    t[2, [2, 3]] = 0.999, 0.001  # one state is hard to leave
    want = Q.mfpt_matrix(t, 2.0)
    solves = []
    monkeypatch.setattr(Q, "mfpt_to", lambda *a: solves.append(1))
    got = {(r.i, r.j): r.t for r in Q.mfpt_table(spark, t, 2.0, block).collect()}
    assert len(got) == 121 and not solves
    assert max(abs(got[i, j] - want[i, j]) / max(1.0, want[i, j]) for i, j in got) < 1e-9


def test_passage_times_of_a_chain_in_parts(spark):
    import numpy as np

    from weftline.operators import passage as Q

    t = np.array([[0.5, 0.5, 0], [0.25, 0.75, 0], [0.1, 0.1, 0.8]])
    want = Q.mfpt_matrix(t)
    got = {(r.i, r.j): r.t for r in Q.mfpt_table(spark, t).collect()}
    assert all(got[i, j] == want[i, j] or abs(got[i, j] - want[i, j]) < 1e-12 for i, j in got)
