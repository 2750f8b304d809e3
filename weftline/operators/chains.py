"""Stationary vectors, committors, passage times and Poisson's equation of chains of any size, on edge tables.

States are dealt to blocks of neighbouring numbers, about BLOCK states each. A sweep joins the edges with the vector
once, corrects the vector by a chain of blocks, and solves every block exactly against what enters it from outside,
each block a small dense system in a task of its own (aggregation and disaggregation). The chain of blocks is solved
densely on the driver up to LOCAL blocks, else by the same operators. Sweeps end when the residual, summed over all
states, is small; if that does not happen within most sweeps, an error is raised, and nothing is returned.

Edges are (from_state, to_state, p); repeated edges add up, edges without weight are left out, rows should sum to one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import kept, ship

from . import components as K
from . import markov as M

BLOCK = 512
LOCAL = 1000
#: Sweeps that are combined into the next vector.
MEMORY = 6


class NotConverged(ArithmeticError):
    """The residual after the last sweep is above the tolerance."""


def _edges(edges: DataFrame) -> DataFrame:
    rows = edges.where("p > 0").groupBy(F.col("from_state").cast("long").alias("a"), F.col("to_state").cast("long").alias("b")).agg(F.sum("p").alias("p"))
    return kept(rows, "chains")


def _dealt(states: DataFrame, block: int) -> DataFrame:
    """(state, block, k): ranges of states of about equal size, k counts from 0 within each."""
    n = states.count()
    rows = states.select("state").repartitionByRange(max(1, -(-n // block)), "state").select("state", F.spark_partition_id().alias("block"))
    rows = kept(rows, "chains")
    return kept(rows.select("state", "block", (F.row_number().over(Window.partitionBy("block").orderBy("state")) - 1).alias("k")), "chains")


def _placed(edges: DataFrame, at: DataFrame) -> DataFrame:
    """edges (a, b, p) with block and place of both ends; those with an end elsewhere are gone."""
    ends = lambda x: at.select(F.col("state").alias(x), F.col("block").alias(f"block_{x}"), F.col("k").alias(f"k_{x}"))
    return kept(edges.join(ends("a"), "a").join(ends("b"), "b"), "chains")


def _matrices(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(block, states, i, j, w): the states of each block in order, and its inner edges; a row for each block."""
    states = at.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "state"))).alias("s")).select("block", F.col("s.state").alias("states"))
    inner = edges.where("block_a = block_b").groupBy(F.col("block_a").alias("block")).agg(F.collect_list(F.struct("k_a", "k_b", "p")).alias("e"))
    inner = inner.select("block", F.col("e.k_a").alias("i"), F.col("e.k_b").alias("j"), F.col("e.p").alias("w"))
    return kept(states.join(inner, "block", "left"), "chains")


def _blocks_solved(matrices: DataFrame, right: DataFrame, turned: bool) -> DataFrame:
    """(state, value): each block's inner system (I - W) x = r, or its transpose; right is (block, k, r)."""
    given = right.groupBy("block").agg(F.collect_list(F.struct("k", "r")).alias("g"))
    rows = matrices.join(given.select("block", F.col("g.k").alias("k"), F.col("g.r").alias("r")), "block", "left")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for states, i, j, w, k, r in zip(*[pdf[c] for c in ("states", "i", "j", "w", "k", "r")], strict=True):
                m, b = np.eye(len(states)), np.zeros(len(states))
                if i is not None:
                    np.subtract.at(m, (np.asarray(i), np.asarray(j)), np.asarray(w))
                if k is not None:
                    b[np.asarray(k)] = r
                yield pd.DataFrame({"state": states, "value": np.linalg.solve(m.T if turned else m, b)})

    ship(matrices.sparkSession)
    return rows.drop("block").mapInPandas(run, "state long, value double")


def _dense(edges: DataFrame, n: int) -> np.ndarray:
    m = np.zeros((n, n))
    for a, b, p in edges.collect():  # of at most LOCAL blocks, or of the states of one
        m[a, b] = p
    return m


# ---- stationary vectors --------------------------------------------------------------------------------------------


def recurrent(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, states) of the closed class with most states, the one with the smallest state of equals, and all states."""
    parts = kept(K.components(edges, edges.select(F.explode(F.array("from_state", "to_state")).alias("state"))), "chains")
    a, b = (parts.select(F.col("state").alias(x), F.col("component").alias(f"c_{x}")) for x in ("from_state", "to_state"))
    both = edges.where("p > 0").join(a, "from_state").join(b, "to_state")
    open_ = both.where("c_from_state <> c_to_state").select(F.col("c_from_state").alias("component")).distinct()
    closed = parts.select("component", "size").distinct().join(open_, "component", "left_anti")
    best = closed.agg(F.min_by("component", F.struct(-F.col("size"), "component"))).first()[0]
    return both.where((F.col("c_from_state") == best) & (F.col("c_to_state") == best)).select("from_state", "to_state", "p"), parts.select("state")


def stationary(edges: DataFrame, block: int = BLOCK, tol: float = 1e-10, most: int = 200, local: int = LOCAL) -> DataFrame:
    """(state, value): stationary probabilities of the largest closed class, 0 elsewhere; empty for no edges.

    The residual is the summed change that one more step makes.
    """
    live, every = recurrent(edges)
    rows = _edges(live)
    found = _stationary(rows, block, tol, most, local)
    return every.join(found, "state", "left").select("state", F.coalesce("value", F.lit(0.0)).alias("value"))


def _stationary(edges: DataFrame, block: int, tol: float, most: int, local: int) -> DataFrame:
    spark = edges.sparkSession
    at = _dealt(edges.select(F.explode(F.array("a", "b")).alias("state")).distinct(), block)
    n, blocks = at.count(), (at.agg(F.max("block")).first()[0] or 0) + 1
    rows = _placed(edges, at)
    inner = _matrices(rows, at)
    none = F.array().cast("array<double>")
    v = at.select("state", "block", "k", F.lit(0.0).alias("base"), F.lit(1.0 / max(n, 1)).alias("value"), none.alias("ys"), none.alias("fs"))
    gap = np.inf
    for _ in range(most):
        from_ = v.select(F.col("state").alias("a"), "value")
        # What each block sends to each state: the one join of edges and vector of a sweep.
        sent = kept(rows.join(from_, "a").groupBy("block_a", "b", "block_b", "k_b").agg(F.sum(F.col("p") * F.col("value")).alias("f")), "chains")
        after = sent.groupBy(F.col("b").alias("state")).agg(F.sum("f").alias("f"))
        gap = v.join(after, "state", "left").agg(F.sum(F.abs(F.coalesce("f", F.lit(0.0)) - F.col("value")))).first()[0] or 0.0
        if gap <= tol:
            return v.select("state", "value")
        mass = v.groupBy("block").agg(F.sum("value").alias("mass"))
        between = sent.groupBy("block_a", "block_b").agg(F.sum("f").alias("f")).join(mass.withColumnRenamed("block", "block_a"), "block_a")
        between = between.select(F.col("block_a").alias("a"), F.col("block_b").alias("b"), (F.col("f") / F.col("mass")).alias("p"))
        if blocks <= local:
            xi = M.steady_state(M.normalized_rows(_dense(between, blocks)))
            share = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xi)], "block int, xi double")
        else:
            share = _stationary(kept(between, "chains"), block, max(tol, 1e-3 * gap), most, local).select(F.col("state").cast("int").alias("block"), F.col("value").alias("xi"))
        scale = share.join(mass, "block").select(F.col("block").alias("block_a"), (F.col("xi") / F.col("mass")).alias("scale"))
        if blocks == 1:
            pi = M.steady_state(_dense(rows.select("k_a", "k_b", "p"), n))  # one block
            found = spark.createDataFrame([(i, float(x)) for i, x in enumerate(pi)], "k int, new double")
            v = v.join(found, "k").withColumn("value", F.col("new")).drop("new")
            continue
        entered = sent.where("block_a <> block_b").join(scale, "block_a").groupBy(F.col("block_b").alias("block"), F.col("k_b").alias("k")).agg(F.sum(F.col("f") * F.col("scale")).alias("r"))
        solved = kept(_blocks_solved(inner, entered, True), "chains")
        total = solved.agg(F.sum("value")).first()[0]
        v = _combined(v, solved.select("state", (F.col("value") / total).alias("y")), least=0.0)
    raise NotConverged(f"residual {gap} after {most} sweeps")


# ---- linear systems ------------------------------------------------------------------------------------------------


def _reaching(edges: DataFrame, held: DataFrame) -> DataFrame:
    """(state) of those that reach a held state."""
    start = held.agg(F.min("state").alias("s")).first()[0]
    spread = held.select(F.lit(start).alias("from_state"), F.col("state").alias("to_state"))
    back = edges.select(F.col("b").alias("from_state"), F.col("a").alias("to_state")).unionByName(spread)
    return K.reached(back, held.where(F.col("state") == start).select("state")).select("state")


def solved(edges: DataFrame, held: DataFrame, gain: DataFrame | float = 0.0, block: int = BLOCK, tol: float = 1e-12, most: int = 400, local: int = LOCAL, lost: float | None = None) -> DataFrame:
    """(state, value): value = gain + T value, with the values of held (state, value) kept.

    gain: one number, or a table (state, gain) with 0 for states that it lacks. States that never reach a held one get
    lost, by default infinity where the gain is one positive number, else 0. The residual is summed over all states and
    set against the sum of all values.
    """
    spark = edges.sparkSession
    rows = _edges(edges)
    held = kept(held.select(F.col("state").cast("long").alias("state"), F.col("value").cast("double").alias("value")).dropDuplicates(["state"]), "chains")
    every = kept(rows.select(F.explode(F.array("a", "b")).alias("state")).unionByName(held.select("state")).distinct(), "chains")
    if held.isEmpty():
        raise ValueError("at least one state must be held")
    lost = lost if lost is not None else float("inf") if isinstance(gain, int | float) and gain > 0 else 0.0
    live = kept(every.join(_reaching(rows, held), "state", "left_semi"), "chains")
    free = live.join(held, "state", "left_anti")
    at = _dealt(free, block)
    gains = free.sparkSession.createDataFrame([], "state long, gain double") if isinstance(gain, int | float) else gain.select(F.col("state").cast("long").alias("state"), "gain")
    fixed = rows.join(held.select(F.col("state").alias("b"), "value"), "b").groupBy(F.col("a").alias("state")).agg(F.sum(F.col("p") * F.col("value")).alias("fixed"))
    base = F.lit(float(gain)) if isinstance(gain, int | float) else F.coalesce("gain", F.lit(0.0))
    at = kept(at.join(gains, "state", "left").join(fixed, "state", "left").select("state", "block", "k", (base + F.coalesce("fixed", F.lit(0.0))).alias("base")), "chains")
    out = _solved(_placed(rows, at), at, tol, most, local, block)
    rest = every.join(live, "state", "left_anti").join(held, "state", "left_anti").select("state", F.lit(float(lost)).alias("value"))
    return out.unionByName(held.select("state", "value")).unionByName(rest)


def _solved(rows: DataFrame, at: DataFrame, tol: float, most: int, local: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    blocks = (at.agg(F.max("block")).first()[0] or 0) + 1
    inner = _matrices(rows, at)
    sizes = at.groupBy("block").agg(F.count("*").alias("n"))
    between = rows.groupBy("block_a", "block_b").agg(F.sum("p").alias("p")).join(sizes.withColumnRenamed("block", "block_a"), "block_a")
    between = kept(between.select(F.col("block_a").alias("a"), F.col("block_b").alias("b"), (F.col("p") / F.col("n")).alias("p")), "chains")
    coarse = np.eye(blocks) - _dense(between, blocks) if blocks <= local else None
    none = F.array().cast("array<double>")
    x = at.select("state", "block", "k", "base", F.col("base").alias("value"), none.alias("ys"), none.alias("fs"))
    gap = np.inf
    for _ in range(most):
        told = rows.join(x.select(F.col("state").alias("b"), "value"), "b").groupBy("a", "block_a", "k_a", "block_b").agg(F.sum(F.col("p") * F.col("value")).alias("g"), F.sum("p").alias("t"))
        told = kept(told, "chains")
        sums = told.groupBy(F.col("a").alias("state")).agg(F.sum("g").alias("g"))
        left = kept(x.join(sums, "state", "left").select("state", "block", (F.col("base") + F.coalesce("g", F.lit(0.0)) - F.col("value")).alias("r"), "value"), "chains")
        now = left.agg(F.sum(F.abs("r")), F.sum(F.abs("value"))).first()
        gap = (now[0] or 0.0) / max(now[1] or 0.0, 1e-300) if now[0] else 0.0
        if gap <= tol:
            return x.select("state", "value")
        mean = left.groupBy("block").agg(F.avg("r").alias("r"))
        if coarse is not None:
            r = np.zeros(blocks)
            for b, m in mean.collect():  # at most LOCAL blocks
                r[b] = m
            lift = spark.createDataFrame([(i, float(e)) for i, e in enumerate(np.linalg.solve(coarse, r))], "block int, e double")
        else:
            top = _dealt(mean.select(F.col("block").cast("long").alias("state")), block)
            top = kept(top.join(mean.select(F.col("block").cast("long").alias("state"), F.col("r").alias("base")), "state"), "chains")
            lift = _solved(_placed(between, top), top, max(tol, 1e-3), most, local, block).select(F.col("state").cast("int").alias("block"), F.col("value").alias("e"))
        outside = told.where("block_a <> block_b").join(lift.select(F.col("block").alias("block_b"), "e"), "block_b").groupBy(F.col("a").alias("state")).agg(F.sum(F.col("g") + F.col("e") * F.col("t")).alias("o"))
        right = at.join(outside, "state", "left").select("block", "k", (F.col("base") + F.coalesce("o", F.lit(0.0))).alias("r"))
        y = _blocks_solved(inner, right, False).withColumnRenamed("value", "y")
        x = _combined(x, y)
    raise NotConverged(f"residual {gap} after {most} sweeps")


def _combined(x: DataFrame, y: DataFrame, least: float | None = None) -> DataFrame:
    """The next vector from the last sweeps' results ys and changes fs: the mix whose change is least (Anderson's mixing).

    With least, a mix that is not above it everywhere is not taken, but the last result.
    """
    last = lambda old, new: F.slice(F.concat(F.array(new), old), 1, MEMORY)
    rows = x.join(y, "state").select("state", "block", "k", "base", last(F.col("ys"), F.col("y")).alias("ys"), last(F.col("fs"), F.col("y") - F.col("value")).alias("fs"))
    rows = kept(rows, "chains")
    m = rows.select(F.size("fs")).first()[0]
    sums = rows.agg(*[F.sum(F.get("fs", F.lit(i)) * F.get("fs", F.lit(j))) for i in range(m) for j in range(i, m)]).first()
    gram, at = np.zeros((m, m)), 0
    for i in range(m):
        for j in range(i, m):
            gram[i, j] = gram[j, i] = sums[at]
            at += 1
    share = np.zeros(m)
    share[0] = 1.0
    if m > 1 and gram[0, 0] > 0:
        d = np.array([[gram[0, 0] - gram[0, i] - gram[j, 0] + gram[j, i] for i in range(1, m)] for j in range(1, m)])
        rhs = np.array([gram[0, 0] - gram[0, i] for i in range(1, m)])
        theta = np.linalg.lstsq(d, rhs, rcond=1e-12)[0]
        if np.isfinite(theta).all() and np.abs(theta).max() < 1e6:
            share[1:], share[0] = theta, 1 - theta.sum()
    value = sum((F.get("ys", F.lit(i)) * float(s) for i, s in enumerate(share)), F.lit(0.0))
    out = rows.withColumn("value", value)
    if least is not None and not out.where(F.col("value") <= least).isEmpty():
        out = rows.withColumn("value", F.get("ys", F.lit(0)))
    return out


def committor(edges: DataFrame, basis: DataFrame, target: DataFrame, **options) -> DataFrame:
    """(state, value): probability of reaching target (state) before basis (state); 0 for states that reach neither."""
    ends = basis.select("state", F.lit(0.0).alias("value")).unionByName(target.select("state", F.lit(1.0).alias("value")))
    return solved(edges, ends.groupBy("state").agg(F.max("value").alias("value")), **options)


def mean_passage(edges: DataFrame, target: DataFrame, **options) -> DataFrame:
    """(state, value): mean steps from each state to target (state); infinite where it is never reached."""
    return solved(edges, target.select("state", F.lit(0.0).alias("value")), 1.0, **options)


def poisson(edges: DataFrame, target: DataFrame, pi: DataFrame | None = None, **options) -> DataFrame:
    """(state, h, v, pi): the discrepancy of reaching target (state), and the deviation of h one step on.

    h = 1_target - pi(target) + T h with pi h = 0. One state of the recurrent class, the likeliest, is held at 0 first;
    then h is shifted.
    """
    pi = kept(pi if pi is not None else stationary(edges, tol=1e-13, **{k: v for k, v in options.items() if k in ("block", "local", "most")}), "chains")
    goal = target.select(F.col("state").cast("long").alias("state"), F.lit(1.0).alias("goal")).dropDuplicates(["state"])
    rows = pi.join(goal, "state", "left").select("state", F.col("value").alias("pi"), F.coalesce("goal", F.lit(0.0)).alias("goal"))
    share = rows.agg(F.sum(F.col("pi") * F.col("goal"))).first()[0] or 0.0
    pin = rows.agg(F.min_by("state", F.struct(-F.col("pi"), "state"))).first()[0]
    held = edges.sparkSession.createDataFrame([(pin, 0.0)], "state long, value double")
    found = solved(edges, held, rows.select("state", (F.col("goal") - share).alias("gain")), **options)
    found = kept(found.join(rows.select("state", "pi"), "state"), "chains")
    shift = found.agg(F.sum(F.col("pi") * F.col("value"))).first()[0]
    h: DataFrame = found.select("state", (F.col("value") - shift).alias("h"), "pi")
    step: Callable = lambda c: M.backed(edges, h.select("state", c.alias("value"))).withColumnRenamed("value", "x")
    once, square = step(F.col("h")).withColumnRenamed("x", "th"), step(F.col("h") * F.col("h")).withColumnRenamed("x", "thh")
    spread = F.coalesce(F.col("thh") - F.col("th") * F.col("th"), F.lit(0.0))
    return h.join(once, "state", "left").join(square, "state", "left").select("state", "h", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("v"), "pi")


def passage_distribution(edges: DataFrame, starts: DataFrame, ends: DataFrame, steps: int, every: int = 8) -> DataFrame:
    """(source, step, p): the probability that a walk from source's start first is in ends (state) after step steps.

    starts: (source, state, value), a distribution for each source; all sources go on together, one join and one sum a
    step, and what has arrived stays aside with its step. A walk that starts in ends counts from its first step on, as
    any other. Steps without arrivals have no row. The walks not yet arrived are kept as a table every few steps.
    """
    goal = ends.select(F.col("state").cast("long").alias("b")).distinct().withColumn("there", F.lit(True))
    rows = kept(_edges(edges).join(goal, "b", "left").select("a", "b", "p", F.col("there").isNotNull().alias("there")), "passages")
    here = starts.select("source", F.col("state").cast("long").alias("a"), F.col("value").cast("double").alias("value")).groupBy("source", "a").agg(F.sum("value").alias("value"))
    walks = here.select("source", "a", F.lit(None).cast("long").alias("step"), "value")
    for k in range(1, steps + 1):
        moved = walks.where("step is null").select("source", "a", "value").join(rows, "a")
        to = F.when(~F.col("there"), F.col("b"))
        moved = moved.groupBy("source", to.alias("a"), F.when(F.col("there"), F.lit(k)).cast("long").alias("step")).agg(F.sum(F.col("p") * F.col("value")).alias("value"))
        walks = walks.where("step is not null").unionByName(moved)
        if k % every == 0:
            walks = kept(walks, "passages")
            if walks.where("step is null").isEmpty():
                break
    return walks.where("step is not null").select("source", "step", F.col("value").alias("p"))
