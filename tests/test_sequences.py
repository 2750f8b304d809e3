"""Sequences counted by signatures against whole paths in memory."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import sequences as Z
from weftline.operators import trajectories as T

SCHEMA = "traj long, part string, idx long, state string"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for t in range(60):
        at, n = rng.randrange(5), rng.choice([1, 2, 3, 9, 21])
        for _ in range(n):
            rows.append((t // 2, "ab"[t % 2], at, rng.choice(["x", "y"] if n < 9 else ["x"])))
            at += rng.randint(1, 4)  # gaps don't matter
    rows += [(None, "a", 3, "x"), (None, "a", 4, "y"), (90, None, 0, "x"), (91, "a", 0, None), (5, "a", 2, None)]
    rng.shuffle(rows)
    return rows


def plain(rows):
    paths = {}
    for t, p, i, s in rows:
        if s is not None:
            paths.setdefault((t, p), []).append((i, s))
    out = {}
    for k, v in paths.items():
        out.setdefault(tuple(s for _, s in sorted(v)), []).append(k)
    return out


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_equal_paths_are_found(spark, block):
    rows = made(block)
    counts, states = Z.sequence_counts(spark.createDataFrame(rows, SCHEMA), ("traj", "part"), block)
    want = plain(rows)
    low = lambda k: (k[0] is not None, k[0] or 0, k[1] is not None, k[1] or "")
    named = {min(v, key=low): (seq, len(v)) for seq, v in want.items()}
    got = {(r.traj, r.part): r for r in counts.collect()}
    assert got.keys() == named.keys()
    total = sum(n for _, n in named.values())
    assert all(got[k].n == n and got[k].length == len(seq) and got[k].weight == pytest.approx(n / total) for k, (seq, n) in named.items())
    found = {}
    for r in states.collect():
        found.setdefault((r.traj, r.part), []).append((r.place, r.state))
    assert {k: [s for _, s in sorted(v)] for k, v in found.items()} == {k: list(seq) for k, (seq, _) in named.items()}
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) for v in found.values())


def test_equals_whole_paths(spark):
    rows = spark.createDataFrame([r for r in made(7) if r[1] == "a" and r[0] is not None and r[3] is not None], SCHEMA)
    counts, _ = Z.sequence_counts(rows)
    whole = T.path_counts(rows)
    assert sorted(r.n for r in counts.collect()) == sorted(r.n for r in whole.collect())


def test_equal_signatures_of_different_sequences_are_told_apart(spark, monkeypatch):
    """The first seed's signatures say nothing; the comparison notices, the second seed settles it."""
    rows = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 0, "y"), (3, "a", 0, "x")], SCHEMA)
    real, seeds = Z.signatures, []

    def weak(df, seed=0):
        seeds.append(seed)
        out = real(df, seed)
        return out if seed else out.select("path", "length", *[F.lit(0).cast("long").alias(c) for c in Z.PARTS])

    monkeypatch.setattr(Z, "signatures", weak)
    counts, _ = Z.sequence_counts(rows)
    assert sorted((r.traj, r.n) for r in counts.collect()) == [(1, 2), (2, 1)] and seeds == [0, 1]


def test_empty(spark):
    counts, states = Z.sequence_counts(spark.createDataFrame([], SCHEMA))
    assert counts.count() == states.count() == 0
