"""Published numbers of the domain, through the Spark path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.predicates import box_centre, check_bounds, in_box, in_interval
from weftline.operators import markov as M
from weftline.operators import passage as Q
from weftline.operators import trajectories as T

ANY = 1e-6


@pytest.fixture(scope="module")
def walks(spark):
    """Three bounded random walks: steps that would leave [0, 100) are not taken."""
    np.random.seed(192348)
    rows = []
    for k in range(3):
        x = 5.0
        for i in range(10_000):
            y = x + np.random.uniform(-10, 10)
            x = y if 0 <= y < 100 else x
            rows.append((k, i, x))
    return spark.createDataFrame(rows, "traj bigint, idx bigint, x double").cache()


def ends(c="x"):
    return in_interval(F.col(c), [0, 10]), in_interval(F.col(c), [90, 100])


def means(df):
    return {r["direction"]: (r["mean"], r["std_err"]) for r in T.mean_passages(df).collect()}


@pytest.mark.parametrize(
    ("only", "ab", "ba"),
    [(True, (220.38095238095238, 32.381265838152025), (255.57142857142858, 36.77686417987655)), (False, (197.28125, 18.417726005823464), (271.5079365079365, 26.119151297618238))],
)
def test_walk_passages(walks, only, ab, ba):
    rows = walks.where("traj = 0") if only else walks
    got = means(T.passages(rows, *ends()))
    assert got["AB"] == pytest.approx(ab, abs=ANY)
    assert got["BA"] == pytest.approx(ba, abs=ANY)


def test_walk_paths(walks):
    found = T.path_lengths(T.paths(walks, *ends()))
    assert found.count() == 64
    assert found.agg(F.avg("steps")).first()[0] == pytest.approx(197.28125)


@pytest.fixture(scope="module")
def sequence(spark):
    np.random.seed(192348)
    s = np.random.randint(0, 3, 100_000)
    return spark.createDataFrame([(0, i, int(v)) for i, v in enumerate(s)], "traj bigint, idx bigint, state bigint").cache()


def coloured_matrix(counts):
    m = np.zeros((6, 6))
    for r in counts.collect():
        m[2 * r["from_state"] + "AB".index(r["from_color"]), 2 * r["to_state"] + "AB".index(r["to_color"])] += r["n"]
    return M.normalized_rows(m)


def test_coloured_lag_100(sequence):
    a, b = F.col("state") == 0, F.col("state") == 2
    t = coloured_matrix(T.coloured_counts(sequence, a, b, 100))
    want = {0: {0: 0.33380383, 2: 0.33455463, 5: 0.33164154}, 2: {0: 0.33983051, 2: 0.32717918, 5: 0.33299031}, 3: {0: 0.32879530, 3: 0.33194167, 5: 0.33926302}, 5: {0: 0.33247538, 3: 0.33109867, 5: 0.33642594}}
    for i in range(6):
        for j in range(6):
            assert t[i, j] == pytest.approx(want.get(i, {}).get(j, 0), abs=1e-8)
    m = Q.coloured_mfpts(t, [0], [2], 100)
    assert (m["AB"], m["BA"]) == pytest.approx((301.1236654158612, 301.88142788292384), abs=ANY)
    assert M.folded(M.steady_state(t)) == pytest.approx([0.33352775, 0.33174116, 0.3347311], abs=1e-7)
    got = means(T.passages(sequence, a, b, 100))
    assert got["AB"] == pytest.approx((312.34567901234567, 19.4177836447053), abs=ANY)
    assert got["BA"] == pytest.approx((306.2111801242236, 19.75290907085678), abs=ANY)


def test_history_colours(sequence):
    # Published numbers of the colour model with lag 1 and no history, rows 1 and 4 empty.
    want = {0: {0: 0.33355320, 2: 0.33412287, 5: 0.33232393}, 2: {0: 0.33502155, 2: 0.32667089, 5: 0.33830756}, 3: {0: 0.33502155, 3: 0.32667089, 5: 0.33830756}, 5: {0: 0.33203883, 3: 0.33430919, 5: 0.33365198}}
    t = coloured_matrix(T.history_model(sequence, [0], [2], 1, 0))
    for i in range(6):
        for j in range(6):
            assert t[i, j] == pytest.approx(want.get(i, {}).get(j, 0), abs=1e-8)
    m = Q.coloured_mfpts(t, [0], [2])
    assert (m["AB"], m["BA"]) == pytest.approx((2.991249925379562, 3.0027466707370256), abs=ANY)
    got = means(T.passages(sequence, F.col("state") == 0, F.col("state") == 2, 1))
    assert got["AB"] == pytest.approx((2.9808209356515505, 0.018764714746890707), abs=ANY)


@pytest.fixture(scope="module")
def five():
    np.random.seed(1)
    return M.normalized_rows(np.random.random((5, 5)))


def test_mfpt_matrix(spark, five):
    want = [[0, 2.62899481, 7.65074814, 4.37254081, 6.42091818], [5.58481382, 0, 6.21851058, 4.00702426, 5.35994556], [4.98545579, 3.15239528, 0, 3.43921253, 7.24671735], [4.37802054, 3.33697554, 6.03713191, 0, 6.81752892], [4.92017417, 3.26320798, 7.20000135, 4.36442835, 0]]
    assert Q.mfpt_matrix(five) == pytest.approx(np.array(want), abs=1e-7)
    table = Q.mfpt_table(spark, five)
    assert table.count() == 25
    low, high = M.extreme_commute(table.where("i <> j")).first(), M.extreme_commute(table.where("i <> j"), True).first()
    assert (low["i"], low["j"], low["commute"]) == (1, 3, pytest.approx(7.343999799826479))
    assert (high["i"], high["j"], high["commute"]) == (2, 4, pytest.approx(14.446718700939037))


def test_markov_passages(five):
    m = Q.markov_mfpts(five, [0], [4])
    assert (m["AB"], m["BA"]) == pytest.approx((6.420918178038423, 4.920174169581114))
    assert Q.directional_mfpt(five, [0], [4]) == pytest.approx(6.420918178038423)
    assert Q.commute_time(five, [0], [4]) == pytest.approx(11.341092347619537)


def test_fpt_distribution(five):
    got = Q.fpt_distribution(five, [0], [4], max_lags=10)
    assert got[0] == (0, 0)
    assert [v for _, v in got[1:]] == pytest.approx([0.11289507, 0.24431041, 0.13232006, 0.11478687, 0.0968178, 0.08185738, 0.06886433, 0.05804509, 0.04890027, 0.04120272], abs=1e-7)


def test_fpt_distribution_on_a_log_scale(five):
    # Times and shares as published.
    got = Q.fpt_distribution(five, [0], [4], max_lags=10, log_scale=True, clean_recycling=True)
    assert [x for x, _ in got] == [0, 10, 166, 2782, 46415, 774263, 12915496, 215443469, 3593813663, 59948425031, 1000000000000]
    assert [v for _, v in got] == pytest.approx([0, 1, 3.85697122e-11] + [0] * 8, rel=1e-6, abs=1e-16)


def test_adaptive_fpt_distribution(five):
    """Shares of what newly enters; beside the step taken back, they add up to what has entered."""
    got = Q.adaptive_fpt_distribution(five, [0], [4], thresh=1.0)
    v, m = np.eye(5)[0], five.copy()
    m[4] = np.eye(5)[4]
    assert [x for x, _ in got[:4]] == [1, 5, 25, 125]
    total = 0.0
    for x, y in got:
        total += y
        assert total == pytest.approx((v @ np.linalg.matrix_power(m, int(x)))[4] if x > 1 else 0)
    fine = Q.adaptive_fpt_distribution(five, [0], [4])
    assert fine[2] == (5.0, fine[1][1])  # the step to 25 was taken back
    assert [x for x, _ in fine[3:8]] == [6, 7, 8, 9, 10]


def test_one_way_chains(five):
    t2 = M.lifted_matrix(five, [0], [4])
    ab = Q.one_way_matrix(t2, [0], [4], "AB")
    assert ab[4].tolist() == [0, 0, 0, 0, 1]
    assert ab[:4] == pytest.approx(five[:4])
    got = Q.directed_fpt_distribution(t2, [0], [4], "AB", 2000)
    assert sum(x * v for x, v in got) == pytest.approx(6.420918178038423, abs=1e-3)
    got = Q.directed_fpt_distribution(t2, [0], [4], "BA", 2000)
    assert sum(x * v for x, v in got) == pytest.approx(4.920174169581114, abs=1e-3)


@pytest.mark.parametrize(
    ("interval", "inside", "outside"),
    [
        ([1, 2], [(1.3,), (1.0,)], [(0.5,), (2.0,)]),
        ([[1, 2], [3, 4]], [(1.9,), (3.3,)], [(0.5,), (2.0,)]),
        ([[1, 2], [0, 1], [0.1, 0.2]], [(1.5, 0.5, 0.15)], [(1.5, 1.5, 0.15)]),
        ([[[1, 2], [0, 1], [0.1, 0.2]], [[2, 3], [1, 2], [0.1, 0.2]]], [(1.5, 0.5, 0.15), (2.5, 1.5, 0.15)], [(1.5, 1.5, 0.15), (2.5, 1.5, 0.3)]),
    ],
)
def test_intervals(spark, interval, inside, outside):
    for points, want in ((inside, True), (outside, False)):
        cols = [f"c{i}" for i in range(len(points[0]))]
        df = spark.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{c} double" for c in cols))
        coords = [F.col(c) for c in cols]
        assert all(r[0] is want for r in df.select(in_interval(coords if len(coords) > 1 else coords[0], interval)).collect())


def test_boxes(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.15,)], "x double")
    assert [r[0] for r in df.select(in_box([F.col("x")], (0.0, 0.15))).collect()] == [False, True, False]
    assert box_centre((0, 10)) == [5]
    assert box_centre((2, float("inf"))) == [2]
    with pytest.raises(AssertionError):
        check_bounds((3, 1))
