"""Flux between states: weighted transition tables (from_state, to_state, w), their profiles and fits.

Segments carry from_cluster and to_cluster (numbers below n), pcoords p0 and p1 and weight. The basis is state n, the
target n + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.predicates import in_box, uniform_bin


def with_states(segments: DataFrame, n: int, basis, target) -> DataFrame:
    """from_state and to_state: an end in the target is the target unless it is in the basis, a start only the basis."""
    start = F.when(in_box([F.col("p0")], basis), F.lit(n)).otherwise(F.col("from_cluster"))
    end = F.when(in_box([F.col("p1")], basis), F.lit(n)).when(in_box([F.col("p1")], target), F.lit(n + 1)).otherwise(F.col("to_cluster"))
    return segments.withColumn("from_state", start.cast("long")).withColumn("to_state", end.cast("long"))


def flux_matrix(segments: DataFrame, n_iters: int | Column = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Weight that goes from state to state, for each value of by, over n_iters."""
    w = F.sum("weight")
    return segments.groupBy(*by, "from_state", "to_state").agg((w / F.lit(n_iters) if isinstance(n_iters, int) else w / F.first(n_iters)).alias("w"))


def total_one(edges: DataFrame) -> DataFrame:
    """Edges over their grand total."""
    total = edges.agg(F.sum("w").alias("_t"))
    return edges.crossJoin(F.broadcast(total)).withColumn("w", F.col("w") / F.col("_t")).drop("_t")


def pcoord_flux(segments: DataFrame, low: float, high: float, n: int, n_iters: int) -> DataFrame:
    """Flux between uniform bins of the coordinate; each iteration's weights sum to one first."""
    totals = segments.groupBy("n_iter").agg(F.sum("weight").alias("_t"))
    rows = segments.join(F.broadcast(totals), "n_iter")
    rows = rows.select(uniform_bin(F.col("p0"), low, high, n).alias("from_state"), uniform_bin(F.col("p1"), low, high, n).alias("to_state"), (F.col("weight") / F.col("_t")).alias("weight"))
    return flux_matrix(rows, n_iters)


def centre_stats(segments: DataFrame, states: DataFrame) -> DataFrame:
    """(state, centre, low, high) of the end coordinates; states without segments get nulls, NaN is left out."""
    got = segments.where(~F.isnan("p1")).groupBy(F.col("to_state").alias("state")).agg(F.avg("p1").alias("centre"), F.min("p1").alias("low"), F.max("p1").alias("high"))
    return states.join(got, "state", "left")


def sorted_states(centres: DataFrame) -> DataFrame:
    """(state, place): places by centre, states without one last; special states (kind not null) after all others."""
    return centres.select("state", (F.row_number().over(Window.orderBy(F.col("kind").isNotNull(), F.col("centre").asc_nulls_last(), "state")) - 1).cast("long").alias("place"))


def relabelled(edges: DataFrame, places: DataFrame) -> DataFrame:
    p = F.broadcast(places)
    out = edges.join(p.withColumnsRenamed({"state": "from_state", "place": "_f"}), "from_state").join(p.withColumnsRenamed({"state": "to_state", "place": "_t"}), "to_state")
    return out.select(F.col("_f").alias("from_state"), F.col("_t").alias("to_state"), "w")


def net_inflow(edges: DataFrame) -> DataFrame:
    """(state, net): weight that enters less weight that leaves."""
    inn = edges.select(F.col("to_state").alias("state"), F.col("w").alias("net"))
    out = edges.select(F.col("from_state").alias("state"), (-F.col("w")).alias("net"))
    return inn.unionByName(out).groupBy("state").agg(F.sum("net").alias("net"))


def profile(edges: DataFrame, places: DataFrame, scale: float = 1.0) -> DataFrame:
    """(place, state, flux): flux over the upper edge of each place; a running sum of net inflow in the order of places.

    places: (state, place), a row for each state, so the ordered window holds no more rows than there are states.
    """
    net = places.join(net_inflow(edges), "state", "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return net.select("place", "state", (F.sum("net").over(w) / scale).alias("flux"))


def coarse_profile(edges: DataFrame, centres: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """(bin, flux): flux over the upper edge of each of n coordinate bins; states without a centre are left out."""
    b = centres.where("centre is not null").select("state", uniform_bin(F.col("centre"), low, high, n).alias("bin"))
    inside = F.broadcast(b)
    rows = edges.join(inside.withColumnsRenamed({"state": "from_state", "bin": "fb"}), "from_state").join(inside.withColumnsRenamed({"state": "to_state", "bin": "tb"}), "to_state")
    net = net_inflow(rows.select(F.col("fb").alias("from_state"), F.col("tb").alias("to_state"), "w"))
    w = Window.orderBy("state").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return net.select(F.col("state").alias("bin"), F.sum("net").over(w).alias("flux"))


def fit_line(points: DataFrame, x: str, y: str, target_before_basis: bool = False) -> DataFrame:
    """(slope, intercept, r, stderr, overcorrected) of a straight line through the points.

    overcorrected: the flux is higher towards the target, which lies at the far end of x unless it comes before the basis.
    """
    fit = points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_syy(y, x).alias("syy"), F.regr_sxx(y, x).alias("sxx"), F.regr_count(y, x).alias("n"))
    err = F.sqrt((1 - F.col("r") * F.col("r")) * F.col("syy") / F.col("sxx") / (F.col("n") - 2))
    return fit.select("slope", "intercept", "r", err.alias("stderr"), (F.col("slope") < 0 if target_before_basis else F.col("slope") > 0).alias("overcorrected"))


def student_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n points under no correlation, by integrating Student's density."""
    import math

    import numpy as np

    df = n - 2
    if df <= 0 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else 1.0
    t = abs(r) * math.sqrt(df / (1 - r * r))
    theta = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 20001)
    v = np.cos(theta) ** (df - 1)
    area = float(((v[1:] + v[:-1]) / 2 * np.diff(theta)).sum())
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return min(1.0, 2 * norm * area)


def block_groups(segments: DataFrame, max_iter: int, groups: int, blocks: int) -> DataFrame:
    """group_id for validation: blocks of equal length dealt in turn; iterations of the remainder, and the last one, are left out.

    With fewer iterations than blocks each iteration is a block.
    """
    per = max(1, max_iter // blocks)
    block = F.expr(f"(n_iter - 1) div {per}")
    return segments.where((block < blocks) & (F.col("n_iter") < max_iter)).withColumn("group_id", (block % groups).cast("long"))


def group_flux(grouped: DataFrame) -> DataFrame:
    """Flux of each group over its own number of iterations: one plan for all groups."""
    n = grouped.groupBy("group_id").agg(F.countDistinct("n_iter").alias("_n"))
    rows = grouped.groupBy("group_id", "from_state", "to_state").agg(F.sum("weight").alias("w"))
    return rows.join(F.broadcast(n), "group_id").withColumn("w", F.col("w") / F.col("_n")).drop("_n")


def direct_flux(segments: DataFrame, arrived: Column, tau: float = 1.0) -> DataFrame:
    """(n_iter, flux): weight that arrives at the target in each iteration."""
    return segments.groupBy("n_iter").agg((F.sum(F.when(arrived, F.col("weight")).otherwise(0.0)) / tau).alias("flux"))


def windowed_flux(flux: DataFrame, window: int) -> DataFrame:
    """(n_iter, flux): mean over the last window iterations before each, and itself; a row for each iteration."""
    w = Window.orderBy("n_iter").rowsBetween(-window, Window.currentRow)
    return flux.select("n_iter", F.avg("flux").over(w).alias("flux"))


def start_weights(segments: DataFrame, pi: DataFrame, special: list[int]) -> DataFrame:
    """Weights of start structures: a segment's share of its state's weight, times the state's probability."""
    total = segments.groupBy("to_state").agg(F.sum("weight").alias("_w"))
    p = pi.where(~F.col("state").isin(special) & (F.col("value") > 0)).select(F.col("state").alias("to_state"), "value")
    rows = segments.join(F.broadcast(total), "to_state").join(F.broadcast(p), "to_state")
    return rows.select("n_iter", "seg_id", "to_state", (F.col("weight") * F.col("value") / F.col("_w")).alias("start_weight"))


def warps(segments: DataFrame, recycled: Column) -> DataFrame:
    """(n_iter, n, w): recycled walkers and their weight in each iteration."""
    return segments.where(recycled).groupBy("n_iter").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))


def smoothed(points: DataFrame, order: str, value: str, window: int) -> DataFrame:
    """Mean and population standard deviation over the window rows before each."""
    w = Window.orderBy(order).rowsBetween(-window, -1)
    return points.select(order, F.avg(value).over(w).alias("mean"), F.stddev_pop(value).over(w).alias("std"))
