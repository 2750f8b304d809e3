"""Histories by doubling against a walk step by step."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.sources import lineage as L
from weftline.sources import segments as S

SCHEMA = "file_idx int, n_iter int, seg_id long, parent_id long, weight double, at long, up long, step int, _r0 int"


def made(seed, iters=70, width=12):
    """Files with recycled walkers, parents that are missing, a null file, a null parent and one hot parent."""
    rng = random.Random(seed)
    rows = []
    for f in (0, 1, None):
        for n in range(1, iters + 1):
            for s in range(width):
                p = 0 if rng.random() < 0.3 else rng.randrange(width)
                p = -1 - rng.randrange(3) if rng.random() < 0.01 else p
                p = 99 if rng.random() < 0.003 else None if rng.random() < 0.003 else p
                rows.append((f, n, s, p, rng.random(), 1, 2, 3, 4))
    return rows


def walk(rows, depth):
    up = {(r[0], r[1], r[2]): r[3] for r in rows}
    found, paths = [], []
    for f, n, s in up:
        at, root, steps = s, None, None
        paths.append((f, n, s, 0, s))
        for k in range(depth):
            p = up.get((f, n - k, at))
            if p is None or p < 0:
                if p is not None:
                    root, steps = at, k
                at = None
                break
            at = p
            paths.append((f, n, s, k + 1, at))
        found.append((f, n, s, at, steps, root))
    return found, paths


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 33, 64])
def test_ancestors(spark, depth):
    rows = made(depth)
    got = L.ancestors(spark.createDataFrame(rows, SCHEMA), depth).select("file_idx", "n_iter", "seg_id", "ancestor", "root_steps", "root")
    assert key(map(tuple, got.collect())) == key(walk(rows, depth)[0])


@pytest.mark.parametrize("depth", [0, 1, 2, 6, 13])
def test_ancestry(spark, depth):
    rows = made(depth, 20)
    got = L.ancestry(spark.createDataFrame(rows, SCHEMA), depth).select("file_idx", "n_iter", "seg_id", "step", "ancestor")
    assert key(map(tuple, got.collect())) == key(walk(rows, depth)[1])


def test_joins_grow_with_the_logarithm(spark, monkeypatch):
    df = spark.createDataFrame(made(1, 3), SCHEMA)
    joins = []
    real = L.joined
    monkeypatch.setattr(L, "joined", lambda *a, **b: joins.append(1) or real(*a, **b))
    L.ancestors(df, 64)
    assert len(joins) == 6
    joins.clear()
    L.ancestors(df, 1000)
    assert len(joins) == 10
    joins.clear()
    L.ancestry(df, 63)
    assert len(joins) == 11
    joins.clear()
    rows = df.withColumn("coord0", F.array("weight")).withColumn("coord1", F.array("weight"))
    S.lagged_pairs(rows, 64, F.array(F.lit(0.0)), F.array(F.lit(1.0)))
    assert len(joins) == 9


def test_repeated_segments_count_once(spark):
    rows = [(0, 1, 5, -1), (0, 2, 6, 5), (0, 2, 6, 5), (0, 3, 7, 6), (0, 3, 7, 8)]
    df = spark.createDataFrame([(*r, 1.0, 0, 0, 0, 0) for r in rows], SCHEMA)
    got = L.ancestors(df, 2).where("n_iter = 3").collect()
    assert [(r.ancestor, r.root) for r in got] == [(5, None)]
    assert L.ancestors(df, 3).where("n_iter = 3").select("ancestor", "root_steps", "root").collect() == [(None, 2, 5)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert L.ancestors(df, 9).count() == L.ancestry(df, 9).count() == 0
    with pytest.raises(ValueError):
        L.ancestors(df, 0)


def test_lagged_pairs_at_larger_lags(spark):
    """Pairs over 5 parents, fixed by hand from the step-by-step walk."""
    rows = [r for r in made(3, 12) if r[0] is not None]
    by = {(r[0], r[1], r[2]): r for r in rows}
    want = []
    for (f, n, s, at, steps, root) in walk(rows, 5)[0]:
        me, first = by[f, n, s], by.get((f, n - 5, 0))
        if steps is not None:
            want.append((-1.0, me[4] + 1, me[4]))
            if first:
                want.append((first[4], -2.0, by[f, n - steps, root][4]))
        elif at is not None and (f, n - 5, at) in by:
            want.append((by[f, n - 5, at][4], me[4] + 1, me[4]))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("coord0", F.array("weight")).withColumn("coord1", F.array(F.col("weight") + 1))
    got = S.lagged_pairs(df.drop("at", "up", "step", "_r0"), 5, F.array(F.lit(-1.0)), F.array(F.lit(-2.0)))
    assert key((r.start[0], r.end[0], r.weight) for r in got.collect()) == key(want)


@pytest.mark.parametrize("depth", [0, 5, 40])
def test_history_sums(spark, monkeypatch, depth):
    """Sums of doubled histories equal those of the ancestors' rows, and no kept table has more rows than segments."""
    df = spark.createDataFrame([r for r in made(depth) if r[2] is not None], SCHEMA).withColumn("v", F.when(F.col("seg_id") % 3 > 0, F.col("weight"))).cache()
    steps = L.joined(L.ancestry(df, depth), df.select("file_idx", "n_iter", "seg_id", "v"), ("file_idx",), F.col("step"), "ancestor", ["v"])
    want = steps.groupBy("file_idx", "n_iter", "seg_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("v"))
    held = []
    real = L.kept
    monkeypatch.setattr(L, "kept", lambda x, name: held.append(real(x, name)) or held[-1])
    got = L.history_sums(df, depth, ["v"]).withColumn("v", F.round("v", 6))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert held and max(h.count() for h in held) <= df.count()
