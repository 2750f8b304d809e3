"""First-passage times of Markov chains: means, distributions, simulated paths. Small matrices, on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .markov import check_rows, lifted_matrix, normalized_rows, steady_state


def mfpt_to(t: np.ndarray, k: int, lag: float = 1.0) -> np.ndarray:
    """Mean first-passage times to state k from every state; inf from those that may never reach it."""
    n = len(t)
    out = np.full(n, math.inf)
    arrives = _leads_to(t, np.arange(n) == k)
    lost = _leads_to(np.where(np.arange(n)[:, None] == k, 0, t), ~arrives)  # once at k, a walk has arrived
    free = np.flatnonzero(~lost & (np.arange(n) != k))
    out[free] = np.linalg.solve(np.eye(len(free)) - t[np.ix_(free, free)], np.ones(len(free)))
    out[k] = 0
    return out * lag


def _leads_to(t: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """States from which some path leads into the goal (a mask), the goal's own among them."""
    seen, step = goal.copy(), t > 0
    while True:
        more = seen | step[:, seen].any(axis=1)
        if (more == seen).all():
            return seen
        seen = more


def mfpt_matrix(t: np.ndarray, lag: float = 1.0) -> np.ndarray:
    return np.stack([mfpt_to(t, k, lag) for k in range(len(t))], axis=1)


def fundamental_matrix(t: np.ndarray, pi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(z, pi) of an irreducible chain: z is the inverse of I - T + 1 pi, from which all passage times follow."""
    pi = steady_state(t) if pi is None else pi
    return np.linalg.inv(np.eye(len(t)) - t + pi[None, :]), pi


def mfpt_table(spark: SparkSession, t: np.ndarray, lag: float = 1.0, block: int = 256) -> DataFrame:
    """(i, j, t) for all pairs of states.

    An irreducible chain is factorised once, on the driver; tasks are sent a block of columns of the fundamental matrix
    each and make their columns' times from it. Of other chains every target is solved by itself, in parallel.
    """
    from .graphs import strong_components

    n, schema = len(t), "i bigint, j bigint, t double"
    if n and len(strong_components(t)) > 1:
        shared = spark.sparkContext.broadcast(t)

        def each(batches: Iterator) -> Iterator:
            import pandas as pd

            for pdf in batches:
                for k in pdf["id"]:
                    yield pd.DataFrame({"i": range(n), "j": [int(k)] * n, "t": mfpt_to(shared.value, int(k), lag)})

        return spark.range(n).mapInPandas(each, schema)
    z, pi = fundamental_matrix(t)
    blocks = [(j, z[:, j : j + block].astype("<f8").tobytes(), z.diagonal()[j : j + block].tolist(), pi[j : j + block].tolist()) for j in range(0, n, block)]
    rows = spark.createDataFrame(blocks, "j bigint, z binary, d array<double>, pi array<double>").repartition(max(1, len(blocks)))

    def columns(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for j, raw, d, p in zip(pdf["j"], pdf["z"], pdf["d"], pdf["pi"], strict=True):
                d, p = np.asarray(d), np.asarray(p)
                m = (d - np.frombuffer(raw, "<f8").reshape(n, len(d))) / p * lag
                at = np.arange(j, j + len(d))
                m[at, at - j] = 0.0
                yield pd.DataFrame({"i": np.repeat(np.arange(n), len(d)), "j": np.tile(at, n), "t": m.ravel()})

    return rows.mapInPandas(columns, schema)


def directional_mfpt(t: np.ndarray, a: list[int], b: list[int], start: np.ndarray | None = None, lag: float = 1.0) -> float:
    """Mean time to reach any of b from a, started by start (probabilities over a; uniform by default)."""
    n = len(t)
    free = np.array([i for i in range(n) if i not in set(b)])
    m = np.linalg.solve(np.eye(len(free)) - t[np.ix_(free, free)], np.ones(len(free)))
    full = np.zeros(n)
    full[free] = m
    p = np.full(len(a), 1 / len(a)) if start is None else np.asarray(start) / np.sum(start)
    return float(p @ full[a]) * lag


def coloured_mfpts(t2: np.ndarray, a: list[int], b: list[int], lag: float = 1.0) -> dict[str, float]:
    """Mean passage times from a coloured matrix: a colour's population over the flux out of it."""
    check_rows(t2)
    pi = steady_state(t2)
    ca, cb = np.arange(0, len(t2), 2), np.arange(1, len(t2), 2)
    ab = sum(pi[i] * t2[i, 2 * e + 1] for i in ca for e in b)
    ba = sum(pi[i] * t2[i, 2 * e] for i in cb for e in a)
    return {"AB": float(lag * pi[ca].sum() / ab) if ab else math.inf, "BA": float(lag * pi[cb].sum() / ba) if ba else math.inf}


def markov_mfpts(t: np.ndarray, a: list[int], b: list[int], lag: float = 1.0) -> dict[str, float]:
    return coloured_mfpts(lifted_matrix(t, a, b), a, b, lag)


def commute_time(t: np.ndarray, a: list[int], b: list[int], lag: float = 1.0) -> float:
    m = markov_mfpts(t, a, b, lag)
    return m["AB"] + m["BA"]


def _merged_target(t: np.ndarray, a: list[int], b: list[int]) -> tuple[np.ndarray, list[int], int]:
    """The matrix with the states of b merged into the first of them, and where a and b then are."""
    targets = sorted(b)
    m = t.astype(float).copy()
    m[:, targets[0]] = m[:, targets].sum(axis=1)
    stay = [i for i in range(len(t)) if i not in set(targets[1:])]
    at = {s: i for i, s in enumerate(stay)}
    return m[np.ix_(stay, stay)], [at[s] for s in a], at[targets[0]]


def fpt_distribution(t: np.ndarray, a: list[int], b: list[int], start: np.ndarray | None = None, max_lags: int = 100, lag: float = 1.0, dt: float = 1.0, log_scale: bool = False, powers: tuple[float, float] = (1, 12), clean_recycling: bool = False) -> list[tuple[float, float]]:
    """(time, share) of first passages from a into b, scaled to sum one, preceded by (0, 0).

    F, at first T - diag T, goes on by F <- T^d (F - diag F), d being the steps to the next time. Times are 1 to
    max_lags, or, on a log scale, max_lags powers of ten spread evenly between powers, where each share is weighed
    with the length of the interval that it stands for. clean_recycling: the target does not feed back.
    """
    m, begin, j = _merged_target(t, a, b)
    if clean_recycling:
        m[j] = 0
    p = np.full(len(begin), 1 / len(begin)) if start is None else np.asarray(start, float) / np.sum(start)
    times = np.logspace(*powers, max_lags, dtype=int) if log_scale else np.arange(max_lags)
    steps = np.diff(times, prepend=0)
    f, shares = m.copy(), []
    for d in steps.tolist():
        f = np.linalg.matrix_power(m, d) @ (f - np.diag(np.diag(f)))
        shares.append(float(p @ f[begin, j]))
    weights = np.array(shares) * (steps if log_scale else 1)
    total = weights.sum()
    at = times if log_scale else times + 1
    return [(0.0, 0.0)] + [(float(x * lag * dt), float(v / total) if total else 0.0) for x, v in zip(at, weights, strict=True)]


def one_way_matrix(t2: np.ndarray, a: list[int], b: list[int], direction: str = "AB") -> np.ndarray:
    """A coloured chain's steps within one direction: the colour left behind, the macrostate ahead absorbing."""
    c, ahead = ("AB".index(direction[0]), np.isin(np.arange(len(t2) // 2), b if direction == "AB" else a))
    out = np.where(ahead[None, :], t2[c::2, 1 - c :: 2], t2[c::2, c::2])
    out[ahead] = np.eye(len(out))[ahead]
    return out


def entry_flux(t2: np.ndarray, into: list[int], direction: str = "AB") -> np.ndarray:
    """Steady flux of one direction into each state of the macrostate that it ends in."""
    c = "AB".index(direction[0])
    flow = steady_state(t2)[c::2] @ t2[c::2]
    return np.array([flow[2 * s] + flow[2 * s + 1] for s in into])


def directed_fpt_distribution(t2: np.ndarray, a: list[int], b: list[int], direction: str = "AB", max_lags: int = 1000, lag: float = 1.0, dt: float = 1.0) -> list[tuple[float, float]]:
    """First passages of a coloured chain in one direction, started where the other direction's flux enters."""
    begin, end = (a, b) if direction == "AB" else (b, a)
    start = entry_flux(t2, begin, direction[::-1])
    return fpt_distribution(one_way_matrix(t2, a, b, direction), begin, end, start, max_lags, lag, dt)


def adaptive_fpt_distribution(t: np.ndarray, a: list[int], b: list[int], start: np.ndarray | None = None, tau: float = 1.0, increment: float = 5.0, fine_increment: float = 1.2, thresh: float = 1e-4, max_steps: int = 1_000_000, max_time: float = math.inf) -> list[tuple[float, float]]:
    """(time, probability that newly enters b by then), at times that grow geometrically from 1.

    Times grow by increment until more than thresh enters at once; that time is taken back (it stands, divided by
    increment, with the value before, which counts as entered again) and times grow by fine_increment from then on.
    Ends once all probability has entered or after max_time.
    """
    m = t.astype(float).copy()
    m[b] = 0
    m[b, b] = 1
    v = np.zeros(len(t))
    v[a] = np.full(len(a), 1 / len(a)) if start is None else np.asarray(start, float) / np.sum(start)
    out, entered, last, grow = [(1.0, 0.0)], 0.0, 1, increment
    for i in range(max_steps - 1):
        now = max(int(last * grow), last + 1)
        new = float((v @ np.linalg.matrix_power(m, now))[b].sum()) - (entered if i else 0.0)
        if i and grow == increment and new > thresh:
            grow = fine_increment
            out.append((now / increment, out[-1][1]))
            entered += out[-1][1]
            continue
        out.append((float(now), new))
        entered += new
        if abs(entered - 1) <= 1e-8 + 1e-5 or now > max_time:
            break
        last = now
    return [(x * tau, y) for x, y in out]


def color_correlation(t2: np.ndarray, a: list[int], b: list[int], times: list[int]) -> list[tuple[int, float, float, float, float]]:
    """(time, AA, AB, BA, BB): mass in the first macrostate after time steps that started in the second."""
    pi = steady_state(t2)
    rows = {"A": [2 * s for s in a], "B": [2 * s + 1 for s in b]}
    out = []
    for n in times:
        m = np.linalg.matrix_power(t2, n)
        vals = []
        for end in "AB":
            for begin in "AB":
                v = np.zeros(len(pi))
                v[rows[begin]] = pi[rows[begin]]
                vals.append(float((v @ m)[rows[end]].sum()))
        out.append((n, *vals))
    return out


def simulate(spark: SparkSession, t: np.ndarray, n_trajs: int, length: int, start: np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """(traj, idx, state): trajectories of a chain; each has a random stream of its own, so partitions don't matter."""
    shared = spark.sparkContext.broadcast((np.cumsum(t, axis=1), np.cumsum(steady_state(t) if start is None else np.asarray(start) / np.sum(start))))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        cum, first = shared.value
        last = len(first) - 1
        for pdf in batches:
            for k in pdf["id"]:
                draws = np.random.default_rng([seed, int(k)]).random(length)
                s = [min(last, int(np.searchsorted(first, draws[0], side="right")))]
                for x in draws[1:]:
                    s.append(min(last, int(np.searchsorted(cum[s[-1]], x, side="right"))))
                yield pd.DataFrame({"traj": int(k), "idx": range(length), "state": s})

    return spark.range(n_trajs).mapInPandas(run, "traj bigint, idx bigint, state bigint")


def simulate_paths(spark: SparkSession, t: np.ndarray, a: list[int], b: list[int], n_paths: int, start: np.ndarray | None = None, max_steps: int = 100_000, seed: int = 0) -> DataFrame:
    """(path_id, path array<int>): paths from a until b, the part before the last visit to a cut off; unfinished ones dropped."""
    p = np.full(len(a), 1 / len(a)) if start is None else np.asarray(start) / np.sum(start)
    shared = spark.sparkContext.broadcast((np.cumsum(t, axis=1), np.cumsum(p), list(a), frozenset(b)))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        cum, first, from_a, into_b = shared.value
        for pdf in batches:
            ids, paths = [], []
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, int(k)])
                path = [from_a[min(len(first) - 1, int(np.searchsorted(first, rng.random(), side="right")))]]
                for _ in range(max_steps):
                    path.append(min(len(cum) - 1, int(np.searchsorted(cum[path[-1]], rng.random(), side="right"))))
                    if path[-1] in into_b:
                        ids.append(int(k))
                        paths.append(path)
                        break
            yield pd.DataFrame({"path_id": pd.Series(ids, dtype="int64"), "path": paths})

    return spark.range(n_paths).mapInPandas(run, "path_id bigint, path array<int>")


def macrostate_populations(pi: np.ndarray, a: list[int], b: list[int]) -> tuple[float, float]:
    """Steady probability of the two macrostates."""
    return float(pi[list(a)].sum()), float(pi[list(b)].sum())


def path_model_mfpt(counts: np.ndarray, a: list[int], b: list[int], lag: float = 1.0) -> float:
    """Mean time from a to b of the chain counted along paths from a to b."""
    return directional_mfpt(normalized_rows(counts), a, b, lag=lag)
