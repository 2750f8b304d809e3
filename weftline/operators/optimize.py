"""Optimised bins for weighted ensembles from a solved chain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discrepancy(t: np.ndarray, pi: np.ndarray, target: list[int] | int) -> tuple[np.ndarray, np.ndarray]:
    """(h, v): the solution of Poisson's equation for reaching the target, and the standard deviation of h one step on."""
    n = len(t)
    goal = np.zeros(n)
    goal[target] = 1
    rhs = goal - pi[target].sum()
    h = np.linalg.solve(np.eye(n) - t + np.outer(pi, pi) / (pi @ pi), rhs)
    v = np.sqrt(np.clip(t @ h**2 - (t @ h) ** 2, 0, None))
    if abs(h @ pi) > 1e-6 * max(1.0, np.abs(h).max()):
        raise ArithmeticError("the discrepancy is not orthogonal to the steady state")
    return h, v


def running_variance(states: DataFrame) -> DataFrame:
    """(state, total): running sum of pi * v in the order of h; a row for each state."""
    w = Window.orderBy("h", "state").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return states.select("state", F.sum(F.col("pi") * F.col("v")).over(w).alias("total"))


def uniform_bins(states: DataFrame, n_bins: int) -> DataFrame:
    """(state, bin): equal shares of the running variance; two of n_bins are left for basis and target."""
    n = n_bins - 2
    if n < 1:
        raise ValueError("more than two bins are needed")
    run = running_variance(states)
    top = run.agg(F.max("total").alias("top"))
    place = F.ceil(F.col("total") / F.col("top") * n) - 1
    return run.crossJoin(F.broadcast(top)).select("state", F.greatest(place, F.lit(0)).cast("long").alias("bin"))


def clustered_bins(h: np.ndarray, v: np.ndarray, pi: np.ndarray, n_bins: int, seed: int = 0) -> np.ndarray:
    """Bins of states by clustering the running variance, which lies on a line: the exact optimum by dynamic programming.

    Bins are numbered along the line; seed is accepted for callers that pass one, as nothing is random.
    """
    order = np.argsort(h, kind="stable")
    x = np.cumsum((pi * v)[order])
    m, k = len(x), min(n_bins - 2, len(x))
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    i = np.arange(m + 1)

    def cost(a: np.ndarray, b: int) -> np.ndarray:
        n = np.maximum(b - a, 1)
        return s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / n

    best = np.full((k + 1, m + 1), np.inf)
    back = np.zeros((k + 1, m + 1), int)
    best[0, 0] = 0
    for c in range(1, k + 1):
        for b in range(c, m + 1):
            total = best[c - 1, :b] + cost(i[:b], b)
            back[c, b] = int(np.argmin(total))
            best[c, b] = total[back[c, b]]
    bins = np.zeros(m, int)
    b = m
    for c in range(k, 0, -1):
        a = back[c, b]
        bins[a:b] = c - 1
        b = a
    out = np.zeros(m, int)
    out[order] = bins
    return out


def optimized_bins(points: DataFrame, mapper: DataFrame, n_bins: int, in_basis: Column, in_target: Column) -> DataFrame:
    """points (state, ...) with their optimised bin: from the state's; basis n_bins - 2, target n_bins - 1, unmapped -1."""
    rows = points.join(F.broadcast(mapper.select("state", F.col("bin").alias("_b"))), "state", "left")
    b = F.when(in_target, F.lit(n_bins - 1)).when(in_basis, F.lit(n_bins - 2)).otherwise(F.coalesce("_b", F.lit(-1)))
    return rows.withColumn("bin", b.cast("long")).drop("_b")


def mapped_points(points: DataFrame, base_bin: Column, remap: DataFrame, centres: DataFrame, mapper: DataFrame, n_bins: int, in_basis: Column, in_target: Column) -> DataFrame:
    """points (x, ...) with their optimised bin: coordinate to base bin, to the bin it was merged into, to microstate, to bin.

    remap (bin, bin_to), centres (bin, state, x) and mapper (state, bin) are what a model was built with; all small. A
    point that no microstate of the mapper takes goes to the bin of the nearest state that the mapper has.
    """
    from .cluster import assigned, nearest

    key = "_row"
    to = F.broadcast(remap.select(F.col("bin").alias("_b"), F.col("bin_to").alias("_to")))
    rows = points.withColumn(key, F.monotonically_increasing_id()).withColumn("_base", base_bin).join(to, F.col("_base") == F.col("_b"), "left")
    rows = rows.withColumn("bin", F.coalesce("_to", "_base")).drop("_b", "_to", "_base")
    found = optimized_bins(assigned(rows, centres), mapper, n_bins, in_basis, in_target)
    known = centres.join(F.broadcast(mapper.select("state", F.col("bin").alias("_bin"))), "state").select(F.col("_bin").alias("state"), "x")
    lost = nearest(found.where("bin < 0").select(key, "x"), known, [key]).select(F.col(key).alias("_lost"), F.col("state").alias("_fixed"))
    return found.join(lost, F.col(key) == F.col("_lost"), "left").withColumn("bin", F.coalesce("_fixed", "bin")).drop(key, "_lost", "_fixed", "state")


def save_mapper(path: str, remap: DataFrame, centres: DataFrame, mapper: DataFrame) -> None:
    """What mapped_points needs, as tables; restored by load_mapper."""
    for name, table in (("remap", remap), ("centres", centres), ("mapper", mapper)):
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_mapper(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("remap", "centres", "mapper"))


def bin_totals(states: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin, share): allocation of walkers in proportion to sqrt of the bin's summed pi^2 * v^2 over its weight."""
    rows = states.join(bins, "state").groupBy("bin").agg(F.sum("pi").alias("w"), F.sum(F.col("pi") * F.col("v") * F.col("v")).alias("s"))
    rows = rows.withColumn("alloc", F.col("w") * F.sqrt(F.col("s") / F.col("w")))
    return rows.withColumn("share", F.col("alloc") / F.sum("alloc").over(Window.partitionBy())).select("bin", "share")


#: Fine bins of the summary from which equal shares are cut.
FINE = 10_000


def value_centres(rows: DataFrame, n: int, method: str = "uniform", fine: int = FINE) -> list[float]:
    """Ascending centres of n bins of a value, from rows (value, pi, var) of segments or states.

    uniform: bins of equal width over the values' range. log_uniform: widths that grow geometrically from the lower end;
    needs a negative least and a positive largest value. equal: bins of about equal allocation, which is a bin's
    weight times the root of its weighted mean of var; cut from a summary of fine equal bins that tasks add up, so the
    driver gets at most fine rows. Null and NaN values don't count; without values there are no centres, with one
    value there is one.
    """
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    low, high = rows.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return []
    if low == high:
        return [float(low)]
    if method == "uniform":
        edges = np.linspace(low, high, n + 1)
    elif method == "log_uniform":
        if not low < 0 < high:
            raise ValueError("values on both sides of 0 are needed")
        edges = np.geomspace(-low / high, 1 - 2 * low / high, n + 1) * high + 2 * low
    elif method == "equal":
        place = F.least(F.floor((F.col("value") - low) / (high - low) * fine), F.lit(fine - 1))
        sums = rows.groupBy(place.alias("place")).agg(F.sum("pi").alias("w"), F.sum(F.col("pi") * F.col("var")).alias("s"))
        got = sorted((r["place"], np.sqrt(max(r["w"] or 0, 0) * max(r["s"] or 0, 0))) for r in sums.collect())
        at, mass = np.array([g[0] for g in got]), np.array([g[1] for g in got])
        if not mass.sum() > 0:
            return value_centres(rows, n, "uniform", fine)
        share = np.cumsum(mass) / mass.sum()
        # Where the summed share first reaches the middle of each n-th part; parts in one fine bin are one.
        picked = np.unique(np.searchsorted(share, (np.arange(n) + 0.5) / n))
        return [float(low + (at[k] + 0.5) * (high - low) / fine) for k in picked]
    else:
        raise ValueError(f"no bins are called {method}")
    return [float(x) for x in (edges[1:] + edges[:-1]) / 2]


def value_bin(value: Column, centres: list[float]) -> Column:
    """Number of the nearest of ascending centres, the lower of equals; null for null or NaN."""
    edges = [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]
    place = sum(((value > e).cast("long") for e in edges), F.lit(0).cast("long"))
    return F.when(value.isNotNull() & ~F.isnan(value), place)


def value_bins(rows: DataFrame, centres: list[float]) -> DataFrame:
    """(bin, n, weight, variance, share): of rows (value, pi, var) in each bin their number and weight, the variance of
    value among them, and the bin's share of the allocation. Bins without rows have no row."""
    out = rows.withColumn("bin", value_bin(F.col("value"), centres)).where("bin is not null")
    out = out.groupBy("bin").agg(F.count("*").alias("n"), F.sum("pi").alias("weight"), F.var_pop("value").alias("variance"), F.sqrt(F.sum("pi") * F.sum(F.col("pi") * F.col("var"))).alias("a"))
    return out.select("bin", "n", "weight", "variance", F.coalesce(F.try_divide(F.col("a"), F.sum("a").over(Window.partitionBy())), F.lit(0.0)).alias("share"))


def walkers(share: DataFrame, total: int, least: int) -> DataFrame:
    """(bin, walkers)."""
    return share.select("bin", (F.round(F.col("share") * total) + least).cast("long").alias("walkers"))


def pcoord_map(original: Column, reduced: Column) -> Column:
    """The extended progress coordinate: the original one, then the reduced features."""
    return F.concat(original, reduced)
