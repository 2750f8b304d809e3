"""Markov chains as edge tables (from_state, to_state, p), and what is solved on a dense matrix on the driver.

States are numbers 0 .. n - 1. dense() is the only place where edges come to the driver; it refuses more than LIMIT
states. For more, power_iteration and fixed_point iterate with joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT = 5000


# ---- edge tables -------------------------------------------------------------------------------------------------


def transition_matrix(edges: DataFrame, states: DataFrame, basis: int | None = None, target: int | None = None) -> DataFrame:
    """Rows of flux normalised to one; rows without flux stay where they are; the target's row goes to the basis."""
    w = Window.partitionBy("from_state")
    live = edges.where("w > 0")
    if target is not None:
        live = live.where(F.col("from_state") != target)
    rows = live.withColumn("p", F.col("w") / F.sum("w").over(w)).select("from_state", "to_state", "p")
    empty = states.select(F.col("state").alias("from_state")).join(live.select("from_state").distinct(), "from_state", "left_anti")
    to = F.when(F.col("from_state") == target, F.lit(basis)).otherwise(F.col("from_state")) if target is not None else F.col("from_state")
    return rows.unionByName(empty.select("from_state", to.cast(edges.schema["to_state"].dataType).alias("to_state"), F.lit(1.0).alias("p")))


def without_states(edges: DataFrame, drop: list[int], weight: str = "w") -> DataFrame:
    """Edges among the other states, normalised by row."""
    rows = edges.where(~F.col("from_state").isin(drop) & ~F.col("to_state").isin(drop) & (F.col(weight) > 0))
    return rows.select("from_state", "to_state", (F.col(weight) / F.sum(weight).over(Window.partitionBy("from_state"))).alias("p"))


def step(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """vector (state, value) one step on: a row vector times the matrix."""
    return edges.join(vector.withColumnRenamed("state", "from_state"), "from_state").groupBy(F.col("to_state").alias("state")).agg(F.sum(F.col("p") * F.col("value")).alias("value"))


def backed(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """The matrix times a column vector."""
    return edges.join(vector.withColumnRenamed("state", "to_state"), "to_state").groupBy(F.col("from_state").alias("state")).agg(F.sum(F.col("p") * F.col("value")).alias("value"))


def power_iteration(edges: DataFrame, states: DataFrame, steps: int, every: int = 10) -> DataFrame:
    """The uniform vector after steps steps, with joins; lineage is cut every few steps through checkpoint()."""
    n = states.count()
    v = states.select("state", F.lit(1.0 / n).alias("value"))
    for k in range(1, steps + 1):
        v = step(edges, v)
        if k % every == 0:
            v = v.checkpoint()
    return v


def normalized_vector(vector: DataFrame) -> DataFrame:
    """vector (state, value) over its sum; one that sums to zero stays as it is."""
    total = vector.agg(F.sum("value").alias("_t"))
    return vector.crossJoin(F.broadcast(total)).select("state", F.coalesce(F.try_divide("value", "_t"), F.col("value")).alias("value"))


def fixed_point(edges: DataFrame, states: DataFrame, ends: DataFrame, steps: int, gain: float = 0.0, every: int = 10) -> DataFrame:
    """(state, value) after steps of value <- gain + T value, with the values of ends (state, value) held.

    A committor holds 0 in the basis and 1 in the target; mean passage times hold 0 in the target and gain 1 a step.
    The lineage is cut by a checkpoint every few steps, so any number of states will do.
    """
    held = ends.select("state", F.col("value").cast("double").alias("_held"))
    out = states.select("state").join(held, "state", "left").select("state", F.coalesce("_held", F.lit(0.0)).alias("value"))
    for k in range(1, steps + 1):
        after = backed(edges, out).withColumnRenamed("value", "_next")
        rows = states.select("state").join(held, "state", "left").join(after, "state", "left")
        out = rows.select("state", F.coalesce("_held", F.coalesce("_next", F.lit(0.0)) + gain).alias("value"))
        if k % every == 0:
            out = out.checkpoint()
    return out


def target_flux(edges: DataFrame, pi: DataFrame, target: int, tau: float = 1.0) -> DataFrame:
    """(flux): probability that enters the target each step, over tau."""
    rows = edges.where((F.col("from_state") != target) & (F.col("to_state") == target)).join(pi.withColumnRenamed("state", "from_state"), "from_state")
    return rows.agg((F.coalesce(F.sum(F.col("p") * F.col("value")), F.lit(0.0)) / tau).alias("flux"))


def checked(edges: DataFrame, states: DataFrame, null_rows: bool = True) -> bool:
    """Whether no weight is negative and every row sums to one (or is empty)."""
    sums = states.select(F.col("state").alias("from_state")).join(edges.groupBy("from_state").agg(F.sum("p").alias("s"), F.min("p").alias("m")), "from_state", "left")
    bad = (F.col("m") < 0) | (F.abs(F.col("s") - 1) > 1e-6) | (F.col("s").isNull() & F.lit(not null_rows))
    return sums.where(bad).isEmpty()


def lifted(edges: DataFrame, a: list[int], b: list[int]) -> DataFrame:
    """Edges between (state, colour): into A colours A, into B colours B, elsewhere the colour stays."""
    colors = F.explode(F.array(F.lit("A"), F.lit("B")))
    rows = edges.withColumn("from_color", colors)
    fits = ~((F.col("from_color") == "A") & F.col("from_state").isin(b)) & ~((F.col("from_color") == "B") & F.col("from_state").isin(a))
    to = F.when(F.col("to_state").isin(a), F.lit("A")).when(F.col("to_state").isin(b), F.lit("B")).otherwise(F.col("from_color"))
    return rows.where(fits).select("from_state", "from_color", "to_state", to.alias("to_color"), "p")


def one_way(edges: DataFrame, color: str, ends: list) -> DataFrame:
    """Coloured edges of one direction: from one colour into any state, the other macrostate's states absorbing."""
    rows = edges.where((F.col("from_color") == color) & (F.col("p") > 0)).select("from_state", "to_state", "p")
    rows = rows.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("from_state")))
    absorbing = edges.select(F.col("to_state").alias("from_state")).where(F.col("from_state").isin(ends)).distinct()
    return rows.unionByName(absorbing.select("from_state", F.col("from_state").alias("to_state"), F.lit(1.0).alias("p")))


def entry_distribution(counts: DataFrame, color: str) -> DataFrame:
    """(state, p): where transitions out of a colour's region enter the other macrostate."""
    rows = counts.where((F.col("from_color") == color) & (F.col("to_color") != color)).groupBy(F.col("to_state").alias("state")).agg(F.sum("n").alias("n"))
    total = rows.agg(F.sum("n").alias("t"))
    return rows.crossJoin(F.broadcast(total)).select("state", (F.col("n") / F.col("t")).alias("p"))


def extreme_commute(mfpts: DataFrame, largest: bool = False) -> DataFrame:
    """(i, j, commute): the pair i < j with the least (or largest) MFPT there and back, the first in row order of equals."""
    back = mfpts.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("t").alias("u"))
    rows = mfpts.where("i < j").join(back, ["i", "j"]).withColumn("c", F.col("t") + F.col("u"))
    key = F.struct((-F.col("c") if largest else F.col("c")).alias("k"), "i", "j")
    return rows.agg(F.min_by(F.struct("i", "j", "c"), key).alias("m")).select("m.i", "m.j", F.col("m.c").alias("commute"))


# ---- dense, on the driver ----------------------------------------------------------------------------------------


def dense(edges: DataFrame, n: int, weight: str = "p") -> np.ndarray:
    if n > LIMIT:
        raise ValueError(f"{n} states; at most {LIMIT} are solved on the driver")
    m = np.zeros((n, n))
    for r in edges.groupBy("from_state", "to_state").agg(F.sum(weight).alias("w")).collect():
        m[r[0], r[1]] = r[2]
    return m


def vector_frame(spark: SparkSession, v: np.ndarray, name: str = "value") -> DataFrame:
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], f"state bigint, {name} double")


def matrix_frame(spark: SparkSession, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "from_state bigint, to_state bigint, p double")


def normalized_rows(m: np.ndarray, reversible: bool = False) -> np.ndarray:
    if (m < 0).any():
        raise ValueError("negative weights")
    m = m + m.T if reversible else m
    s = m.sum(axis=1, keepdims=True)
    return np.divide(m, s, out=np.zeros_like(m, dtype=float), where=s > 0)


def check_rows(t: np.ndarray, null_rows: bool = True) -> bool:
    s = t.sum(axis=1)
    ok = np.abs(s - 1) <= 1e-6
    if null_rows:
        ok |= s == 0
    if (t < 0).any() or not ok.all():
        raise ValueError("not a transition matrix")
    return True


def cleaned(t: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Without states that are never entered or never left, from the last to the first; and the states that stay."""
    stay = list(range(len(t)))
    for i in range(len(t) - 1, -1, -1):
        k = stay.index(i)
        sub = t[np.ix_(stay, stay)]
        if sub[:, k].sum() - sub[k, k] == 0 or sub[k].sum() - sub[k, k] == 0:
            stay.pop(k)
    return normalized_rows(t[np.ix_(stay, stay)]), stay


def steady_state(t: np.ndarray) -> np.ndarray:
    """Stationary probabilities by state elimination, which subtracts nothing; for one recurrent class.

    States outside of the class get 0; of several classes the one with most states is taken.
    """
    from .graphs import strong_components

    n = len(t)
    parts = strong_components(t)
    closed = [c for c in parts if not t[np.ix_(c, [j for j in range(n) if j not in set(c)])].any()]
    live = sorted(max(closed, key=len)) if closed else list(range(n))
    a = t[np.ix_(live, live)].astype(float).copy()
    m = len(live)
    for k in range(m - 1, 0, -1):
        s = a[k, :k].sum()
        if s <= 0:
            continue
        a[:k, k] /= s
        a[:k, :k] += np.outer(a[:k, k], a[k, :k])
    pi = np.zeros(m)
    pi[0] = 1.0
    for k in range(1, m):
        pi[k] = pi[:k] @ a[:k, k]
    out = np.zeros(n)
    out[live] = pi / pi.sum()
    return out


def inverse_iteration(t: np.ndarray, shift: float = 1.0 + 1e-9, guess: np.ndarray | None = None) -> np.ndarray:
    """The left eigenvector nearest to shift by one shifted solve, scaled to sum one; shift must not be an eigenvalue."""
    v = np.linalg.solve(t.T - shift * np.eye(len(t)), np.ones(len(t)) if guess is None else guess)
    return v / v.sum()


def steady_state_algebraic(t: np.ndarray, max_iters: int = 1000, check_negative: bool = True) -> np.ndarray:
    """The dominant left eigenvector; negative parts are repaired by powers of the matrix."""
    values, vectors = np.linalg.eig(t.T)
    v = np.real(vectors[:, np.argmin(np.abs(values - 1))])
    v = v / v.sum()
    if check_negative:
        for _ in range(max_iters):
            if (v >= 0).all():
                break
            v = np.clip(v, 0, None) @ t
            v /= v.sum()
    return v


def steady_state_powers(t: np.ndarray, conv: float = 1e-8, most: int = 10000) -> np.ndarray:
    """The uniform vector carried on until ten steps change it by less than conv."""
    v = np.full(len(t), 1.0 / len(t))
    for _ in range(most // 10):
        u = v
        for _ in range(10):
            v = v @ t
        if np.abs(v - u).sum() < conv:
            break
    return v


def flux_into(t: np.ndarray, pi: np.ndarray, basis: int, target: int, lagtime: float = 1.0) -> float:
    """Steady flux into the target; -1 where the basis doesn't reach it."""
    from .graphs import reaches

    if not reaches(t, [basis], [target]):
        return -1.0
    keep = np.arange(len(t)) != target
    return float(pi[keep] @ t[keep, target] / lagtime)


def committor(t: np.ndarray, basis: list[int], target: list[int]) -> np.ndarray:
    """Probability of reaching the target before the basis; both are absorbing. States that reach neither get 0."""
    n = len(t)
    q = np.zeros(n)
    q[target] = 1.0
    inner = np.array([i for i in range(n) if i not in set(basis) | set(target)], int)
    if len(inner):
        a = np.eye(len(inner)) - t[np.ix_(inner, inner)]
        b = t[np.ix_(inner, target)].sum(axis=1)
        q[inner] = np.linalg.lstsq(a, b, rcond=None)[0] if np.linalg.matrix_rank(a) < len(inner) else np.linalg.solve(a, b)
    return np.clip(q, 0, 1)


def committor_steps(t: np.ndarray, basis: int, target: int, steps: int | None = None, conv: float = 1e-5, most: int = 100_000) -> np.ndarray:
    """The same by iteration: a fixed number of steps, or until the change is at most conv."""
    m = t.copy()
    m[[basis, target]] = 0
    q = np.zeros(len(t))
    q[target] = 1
    for _ in range(steps or most):
        new = m @ q
        new[target] = 1
        done = np.abs(new - q).sum() <= conv
        q = new
        if steps is None and done:
            break
    return q


def backward_committor(t: np.ndarray, pi: np.ndarray, basis: list[int], target: list[int]) -> np.ndarray:
    """Probability of having come from the basis rather than the target: the committor of the reversed chain."""
    back = normalized_rows(t.T * pi[None, :])
    return committor(back, target, basis)


def evolved(p0: np.ndarray, t: np.ndarray, steps: int, store: int = 1) -> list[tuple[int, np.ndarray]]:
    """(step, distribution) for every store-th step, the start included."""
    out, p = [(0, p0)], p0
    for k in range(1, steps + 1):
        p = p @ t
        if k % store == 0:
            out.append((k, p))
    return out


def evolved_flux(p0: np.ndarray, t: np.ndarray, target: int, steps: int, tau: float = 1.0) -> list[tuple[int, float]]:
    """Flux into the target from each transient distribution."""
    keep = np.arange(len(t)) != target
    return [(k, float(p[keep] @ t[keep, target] / tau)) for k, p in evolved(p0, t, steps)]


def random_markov_matrix(n: int, seed: int | None = None) -> np.ndarray:
    return normalized_rows(np.random.default_rng(seed).random((n, n)))


def weighted_choice(items: list, weights: list[float], rng: np.random.Generator):
    return items[int(np.searchsorted(np.cumsum(weights) / sum(weights), rng.random(), side="right"))]


def folded(pi2: np.ndarray) -> np.ndarray:
    """Populations of states from those of (state, colour) pairs."""
    return pi2.reshape(-1, 2).sum(axis=1)


def lifted_matrix(t: np.ndarray, a: list[int], b: list[int]) -> np.ndarray:
    """(2n, 2n): row 2s for state s in colour A, 2s + 1 in colour B."""
    n = len(t)
    out = np.zeros((2 * n, 2 * n))
    for c in (0, 1):
        start = [s for s in range(n) if s not in set(b if c == 0 else a)]
        for s in start:
            for e in range(n):
                out[2 * s + c, 2 * e + (0 if e in a else 1 if e in b else c)] += t[s, e]
    return out


def accumulated_flux(t: np.ndarray, target: list[int], tau: float = 1.0, conv: float = 1e-6, max_iters: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, kh, varh): flux into the target gathered from each state beyond its mean, until it settles; T h; T h^2 - (T h)^2.

    The flux after n steps comes from the matrix to the power n, from states that aren't targets into those that are.
    """
    n = len(t)
    other = np.setdiff1d(np.arange(n), target)
    out_rate = t[np.ix_(other, target)].sum(axis=1) / tau
    power, total, h, mean = t.copy(), np.zeros(n), np.zeros(n), 0.0
    for k in range(1, max_iters + 1):
        f = power[:, other] @ out_rate
        total += f
        now = f[other].mean()
        new = total - k * now
        top = new.max()
        settled = top > 0 and np.abs(new - h).max() <= conv * top and abs(now - mean) <= conv * now
        h, mean, power = new, now, power @ t
        if settled:
            break
    kh = t @ h
    return h, kh, t @ h**2 - kh**2
