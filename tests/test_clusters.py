"""Stratified k-means over all points of a bin."""

import numpy as np
import pytest

from weftline.operators import cluster as C


def test_every_point_counts(spark):
    """A bin of many light points and a few heavy ones: each centre is the weighted mean of all points nearest to it."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(30_000, 2)), rng.normal(size=(5, 2)) + [40, 0], rng.normal(size=(5, 2)) + [0, 40]])
    w = np.concatenate([np.full(30_000, 1e-6), np.full(10, 1.0)])
    rows = [(7, p.tolist(), float(v)) for p, v in zip(x, w, strict=True)] + [(8, [1.0, 2.0], 1.0)] * 4 + [(8, [3.0, 2.0], 1.0)]
    df = spark.createDataFrame(rows, "bin bigint, x array<double>, weight double").repartition(5)
    one = {r["bin"]: r["x"] for r in C.stratified_centres(df, 1).collect()}
    assert one[7] == pytest.approx(np.average(x, axis=0, weights=w))
    assert one[8] == pytest.approx([1.4, 2.0])
    assert {r["bin"] for r in C.stratified_centres(df.where("bin = 8").repartition(9), 1).collect()} == {8}  # most tasks have no rows
    got = C.stratified_centres(df, 3, 5).collect()
    assert sorted(r["x"] for r in got if r["bin"] == 8) == [[1.0, 2.0], [3.0, 2.0]]
    c = np.array([r["x"] for r in got if r["bin"] == 7])
    own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
    assert c == pytest.approx(np.array([np.average(x[own == i], axis=0, weights=w[own == i]) for i in range(3)]))
    assert len(set(own[-10:-5]) & set(own[-5:])) == 0


def cost(x, c):
    return ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum()


def plain(x, k, rng):
    """k-means++ one centre after the other, then Lloyd."""
    c = x[[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())]])
    for _ in range(100):
        own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
    return c


def test_passes_do_not_grow_with_k_and_the_cost_is_no_worse(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(60, 4)) + rng.normal(size=4) * 12 for _ in range(15)])
    df = spark.createDataFrame([(b, p.tolist()) for b in (1, 2) for p in x], "bin bigint, x array<double>").repartition(6)
    passes = []
    real = C._drawn, C._moved
    monkeypatch.setattr(C, "_drawn", lambda *a: passes.append(2) or real[0](*a))
    monkeypatch.setattr(C, "_moved", lambda *a: passes.append(1) or real[1](*a))
    rows = C.kept(df.withColumn("weight", C.F.lit(1.0)), "points")
    for k in (2, 15):
        passes.clear()
        C.seeded_centres(rows, k, 3)
        assert sum(passes) == 2 * C.ROUNDS + 1
    got = C.stratified_centres(df, 15, 3).collect()
    best = np.median([cost(x, plain(x, 15, rng)) for _ in range(9)])
    for b in (1, 2):
        assert cost(x, np.array([r["x"] for r in got if r["bin"] == b])) <= 1.05 * best


def test_points_that_do_not_count(spark):
    rows = [(1, [0.0, 1.0], 1.0), (1, None, 1.0), (1, [None, 1.0], 1.0), (None, [5.0, 5.0], 1.0), (2, [7.0, 7.0], 0.0)] + [(1, [2.0, 1.0], 1.0)] * 50
    got = C.stratified_centres(spark.createDataFrame(rows, "bin bigint, x array<double>, weight double"), 4)
    assert [(r["bin"], r["x"]) for r in got.collect()] == [(1, [0.0, 1.0]), (1, [2.0, 1.0])]
    assert C.stratified_centres(spark.createDataFrame([], "bin bigint, x array<double>"), 2).count() == 0


def test_many_coordinates(spark):
    """1,881 coordinates: sums travel as one array each, so the plan does not grow with them."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 1881)) + np.repeat([[0.0], [9.0]], 20, axis=0)
    got = C.stratified_centres(spark.createDataFrame([(0, p.tolist()) for p in x], "bin bigint, x array<double>"), 2).collect()
    assert np.array([r["x"] for r in got]) == pytest.approx(np.array([x[:20].mean(axis=0), x[20:].mean(axis=0)])[np.lexsort(np.array([x[:20].mean(axis=0), x[20:].mean(axis=0)]).T[::-1])])


def test_passes_take_small_batches_together(spark):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"bin": [i % 3], "x": [[float(i)]]}) for i in range(C.CHUNK_ROWS + 5)]
    got = list(C._chunks(iter(batches)))
    assert [b.num_rows for b in got] == [C.CHUNK_ROWS, 5]
    points = spark.createDataFrame([(i, i % 3 if i % 5 else None, [float(i % 40), 1.0]) for i in range(2000)], "i long, bin long, x array<double>").repartition(7)
    centres = spark.createDataFrame([(b, k, 2 * b + k, [30.0 * k, 1.0]) for b in (0, 1) for k in (0, 1)], "bin long, local_id long, state long, x array<double>")
    rows = C.assigned(points, centres)
    plan = rows._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    for r in rows.collect():
        assert r.state == (None if r.bin in (None, 2) else 2 * r.bin + (r.x[0] > 15)) or r.x[0] == 15
        assert r.x == [float(r.i % 40), 1.0] and r.bin == (r.i % 3 if r.i % 5 else None)


def test_coordinates_of_a_bin_must_have_one_length():
    import numpy as np
    import pyarrow as pa
    import pytest

    batch = pa.RecordBatch.from_pydict({"bin": [1, 2, None, 1], "x": [[0.0, 1.0], [5.0], [9.0], [2.0, None]]})
    found = {b: x.tolist() for b, _, x, _ in C._by_bin(batch.slice(0, 3), {})}
    assert found == {1: [[0.0, 1.0]], 2: [[5.0]]}
    assert np.isnan(dict((b, x) for b, _, x, _ in C._by_bin(batch, {}))[1][1, 1])
    with pytest.raises(ValueError):
        C._coordinates(batch.column("x"))(np.array([0, 1]))
