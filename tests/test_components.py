"""Components, reachability and cleaning on edge tables against plain searches on random graphs."""

import random

import numpy as np
import pytest

from weftline.operators import components as K
from weftline.operators import graphs as G
from weftline.operators import markov as M


def graph(seed):
    """Edges among 60 states: cycles of several lengths, chains between them, loops, repeats and a null."""
    rng = random.Random(seed)
    edges = []
    at = 0
    while at < 50:
        n = rng.choice([1, 1, 2, 3, 9])
        edges += [(at + i, at + (i + 1) % n) for i in range(n)]
        at += n
    edges += [(rng.randrange(60), rng.randrange(60)) for _ in range(25)] + edges[:3] + [(None, 3), (4, None)]
    rng.shuffle(edges)
    return edges


def matrix(edges, n=60):
    m = np.zeros((n, n))
    for a, b in edges:
        if a is not None and b is not None:
            m[a, b] = 1
    return m


SCHEMA = "from_state long, to_state long"


@pytest.mark.parametrize(("seed", "directed", "local"), [(1, True, 0), (2, True, 0), (3, True, 12), (4, True, 1000), (5, False, 0), (6, False, 1000)])
def test_components(spark, seed, directed, local):
    edges = graph(seed)
    states = spark.range(60).withColumnRenamed("id", "state")
    got = K.components(spark.createDataFrame(edges, SCHEMA), states, directed, local)
    want = [(s, p[0], len(p)) for p in G.strong_components(matrix(edges), directed) for s in p]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_long_ways_take_few_rounds(spark, monkeypatch):
    """A line of 600 states there and back, the worst case of a search step by step."""
    edges = [(i, i + 1) for i in range(600)] + [(i + 1, i) for i in range(600)]
    made = []
    real = K.kept
    monkeypatch.setattr(K, "kept", lambda df, name: made.append(1) or real(df, name))
    got = K.components(spark.createDataFrame(edges, SCHEMA), local_edges=0).select("component", "size").distinct().collect()
    assert got == [(0, 601)]
    assert len(made) < 60


@pytest.mark.parametrize(("seed", "directed", "local"), [(7, True, 0), (8, False, 1000)])
def test_reached(spark, seed, directed, local):
    edges = graph(seed)
    m = matrix(edges)
    df = spark.createDataFrame(edges, SCHEMA)
    sources = [0, 17, 59]
    frame = lambda s: spark.createDataFrame([(x,) for x in s], "state long")
    got = sorted(map(tuple, K.reached(df, frame([*sources, 17]), directed, local).collect()))
    want = sorted((s, e) for s in sources for e in range(60) if G.reaches(m, [s], [e], directed))
    assert got == want
    near = [e for s, e in want if s == 17]
    assert K.connected(df, frame([17]), frame(near), directed, local)
    assert not K.connected(df, frame([17]), frame([*near, 1000]), directed, local)


@pytest.mark.parametrize("seed", range(4))
def test_cleaned(spark, seed):
    rng = np.random.default_rng(seed)
    n = 14
    t = rng.random((n, n)) * (rng.random((n, n)) < 0.12)
    got = K.cleaned_edges(M.matrix_frame(spark, t))
    want, stay = M.cleaned(t)
    rows = {(stay[i], stay[j]): want[i, j] for i, j in zip(*np.nonzero(want), strict=True)}
    got = {(r.from_state, r.to_state): r.p for r in got.collect()}
    assert got.keys() == rows.keys() and all(abs(got[k] - rows[k]) < 1e-12 for k in rows)


def test_cleaning_keeps_what_only_a_smaller_state_fed(spark):
    """1 feeds 2 and goes itself, being fed by none: 2 was judged before and stays."""
    t = np.array([[0.0, 0, 0.5, 0.5], [0, 0, 1, 0], [1, 0, 0, 0], [1, 0, 0, 0]])
    t[0, 2] = 0
    got = {(r.from_state, r.to_state) for r in K.cleaned_edges(M.matrix_frame(spark, t)).collect()}
    want, stay = M.cleaned(t)
    assert got == {(stay[i], stay[j]) for i, j in zip(*np.nonzero(want), strict=True)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert K.components(none).count() == 0
    assert K.components(none, spark.range(3).withColumnRenamed("id", "state")).count() == 3
    assert K.reached(none, spark.createDataFrame([(4,)], "state long")).collect() == [(4, 4)]
    assert K.cleaned_edges(spark.createDataFrame([], SCHEMA + ", p double")).count() == 0


def test_rounds_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    real = K.kept
    monkeypatch.setattr(K, "kept", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    edges = spark.createDataFrame(graph(3), SCHEMA)
    K.components(edges, local_edges=0).collect()
    K.reached(edges, spark.createDataFrame([(0,)], "state long"), local_edges=0).collect()
    K.cleaned_edges(edges.withColumn("p", K.F.lit(1.0))).collect()
    assert plans and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize(("seed", "directed", "local"), [(11, True, 0), (12, True, 1000), (13, True, 1000), (14, False, 1000)])
def test_reach_counts(spark, seed, directed, local):
    """Two copies of a graph side by side, two hubs: counts equal the pairs."""
    edges = graph(seed) + [(a + 100, b + 100) for a, b in graph(seed) if a is not None and b is not None]
    df = spark.createDataFrame(edges, SCHEMA)
    sources = spark.createDataFrame([(x,) for x in [*range(0, 160, 2), 999, None]], "state long")
    want = {}
    for s, e in K.reached(df, sources, directed, local).collect():
        n, last = want.get(s, (0, -1))
        want[s] = (n + 1, max(last, e))
    got = {r.source: (r.n, r.last) for r in K.reach_counts(df, sources, directed, local).collect()}
    assert got == want and 999 in got


def test_sources_before_a_hub_make_no_pairs_with_it(spark, monkeypatch):
    """300 sources before a cycle with a tail of 300: the search beside the hub holds each source only once."""
    edges = [(1000 + i, 0) for i in range(300)] + [(i, (i + 1) % 5) for i in range(5)] + [(2000 + i - (i > 0) if i else 4, 2000 + i) for i in range(6)]
    edges += [(2005, 3000 + i) for i in range(300)]
    held = []
    real = K._searched
    monkeypatch.setattr(K, "_searched", lambda *a: held.append(real(*a)) or held[-1])
    got = K.reach_counts(spark.createDataFrame(edges, SCHEMA), spark.range(1000, 1300).withColumnRenamed("id", "state")).collect()
    assert {(r.n, r.last) for r in got} == {(1 + 5 + 6 + 300, 3299)} and len(got) == 300
    assert held[1].count() == 300
