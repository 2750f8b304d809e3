"""Ordered trajectories (traj, idx, ...): visits to two macrostates, first passages, coloured pairs, paths, counts.

in_a and in_b are Boolean columns over a row. A row's colour is the macrostate visited last, A being tested first;
it is unknown (null) before the first visit. All windows of one operator share partition and order, so each plan
has one exchange and one sort of the trajectories.

With block, an operator never needs a whole trajectory in one task: rows are dealt by (traj, idx div block), a summary
row for each block carries what came before it (the last label, a running count), and rows that look a fixed number
of steps back or ahead are sent to the neighbouring block, too. Only the summary rows of a trajectory meet in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import kept

KEYS = ("traj",)


def _by(keys=KEYS):
    return Window.partitionBy(*keys).orderBy("idx")


#: Rows of a block where callers ask for blocks.
BLOCK = 1 << 16


def from_log(log: DataFrame, traj: str, order: list[str], bucket: Column | None = None, **columns: str) -> DataFrame:
    """Trajectories from an event log: idx numbers the rows of each traj by order, from 0.

    bucket: a column that never falls as order goes on, such as the day of a time; then rows are numbered within
    (traj, bucket), and each bucket's rows start where the buckets before it end.
    """
    out = [F.col(traj).alias("traj"), *[F.col(c).alias(n) for n, c in columns.items()]]
    if bucket is None:
        w = Window.partitionBy(traj).orderBy(*order)
        return log.select(out[0], (F.row_number().over(w) - 1).cast("long").alias("idx"), *out[1:])
    rows = log.withColumn("_b", bucket)
    sizes = rows.groupBy(traj, "_b").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy(traj).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Each bucket's start comes as a row of its own, before all others there, so that the rows move once.
    starts = sizes.select(traj, "_b", first.alias("_first"), F.lit(0).alias("_own"))
    both = rows.withColumn("_own", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(traj, "_b").orderBy("_own", *order)
    idx = F.max("_first").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.row_number().over(w) - 2
    return both.withColumn("_idx", idx.cast("long")).where("_own = 1").select(out[0], F.col("_idx").alias("idx"), *out[1:])


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    return rows.withColumn("_b", F.expr(f"idx div {int(block)}"))


def _joined(rows: DataFrame, summary: DataFrame, keys) -> DataFrame:
    """rows (keys, _b, ...) with the columns of summary (keys, _b, ...); null keys are equal."""
    names = [*keys, "_b"]
    side = summary.withColumnsRenamed({c: f"_s{i}" for i, c in enumerate(names)})
    on = F.lit(True)
    for i, c in enumerate(names):
        on = on & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    return rows.join(side, on, "left").drop(*[f"_s{i}" for i in range(len(names))])


def previous(rows: DataFrame, columns: list[str], keys, block: int) -> DataFrame:
    """rows with _prev: a struct of columns of the row before by idx, null for a trajectory's first."""
    return previous_in(rows, columns, keys, F.expr(f"idx div {int(block)}"), ["idx"])


def previous_in(rows: DataFrame, columns: list[str], keys, bucket: Column, order: list[str]) -> DataFrame:
    """rows with _prev: a struct of columns of the row before by order, null for a trajectory's first.

    bucket never falls as order goes on, such as the day of a time: rows move once, by (keys, bucket). A bucket's last
    values go to the trajectory's next bucket as a row of their own, before all others there.
    """
    of = F.struct(*columns)
    rows = rows.withColumn("_b", bucket).withColumn("_own", F.lit(1)).withColumn("_now", of)
    ends = rows.groupBy(*keys, "_b").agg(F.max_by("_now", F.struct(*order)).alias("_now"))
    ends = ends.withColumn("_to", F.lead("_b").over(Window.partitionBy(*keys).orderBy("_b"))).where("_to is not null")
    ends = ends.select(*keys, F.col("_to").alias("_b"), F.lit(0).alias("_own"), "_now")
    both = rows.unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_own", *order)
    return both.withColumn("_prev", F.lag("_now").over(w)).where("_own = 1").drop("_b", "_own", "_now")


def _coloured(rows: DataFrame, keys, block: int | None) -> DataFrame:
    """rows (keys, idx, lab, ...) with color, the last label so far, and before, the color of the row before."""
    if block is None:
        w = _by(keys)
        out = rows.withColumn("color", F.last("lab", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return out.withColumn("before", F.lag("color").over(w))
    rows = _in_blocks(rows, block).withColumn("_own", F.lit(1))
    last = rows.groupBy(*keys, "_b").agg(F.max_by("lab", F.when(F.col("lab").isNotNull(), F.col("idx"))).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_b", F.last("_last", ignorenulls=True).over(over).alias("lab"), F.lit(0).alias("_own"))
    both = rows.unionByName(carry.where("lab is not null"), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("_own", "idx")
    both = both.withColumn("color", F.last("lab", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return both.withColumn("before", F.lag("color").over(w)).where("_own = 1").drop("_own", "_b")


def _with_neighbours(rows: DataFrame, back: int, ahead: int, block: int) -> DataFrame:
    """rows in blocks (_b), with _own; those within back rows of a block's start also stand in the block before it, and
    those within ahead rows of its end also in the block after it."""
    if max(back, ahead) > block:
        raise ValueError("a block must hold the rows that are looked back and ahead")
    at = F.col("idx") % block
    copies = [F.struct(F.lit(0).alias("d"), F.lit(True).alias("own"))]
    if ahead:
        copies.append(F.when(at >= block - ahead, F.struct(F.lit(1).alias("d"), F.lit(False).alias("own"))))
    if back:
        copies.append(F.when((at < back) & (F.col("idx") >= block), F.struct(F.lit(-1).alias("d"), F.lit(False).alias("own"))))
    out = _in_blocks(rows, block).withColumn("_c", F.explode(F.array_compact(F.array(*copies))))
    return out.withColumn("_own", F.col("_c.own")).withColumn("_b", F.col("_b") + F.col("_c.d")).drop("_c")


def macrostate(in_a: Column, in_b: Column) -> Column:
    return F.when(in_a, F.lit("A")).when(in_b, F.lit("B"))


def discretized(trajs: DataFrame, state: Column) -> DataFrame:
    """A discrete ensemble from a continuous one: state maps a row's coordinates to its label."""
    return trajs.select("traj", "idx", state.alias("state"))


def sliced(trajs: DataFrame, start: int = 0, stop: int | None = None, keys=KEYS) -> DataFrame:
    """Rows start <= idx < stop of each trajectory, numbered anew."""
    rows = trajs.where(F.col("idx") >= start) if stop is None else trajs.where((F.col("idx") >= start) & (F.col("idx") < stop))
    return rows.withColumn("idx", F.col("idx") - start)


def strided(trajs: DataFrame, lag: int) -> DataFrame:
    """Every lag-th row of each trajectory, numbered anew."""
    return trajs if lag == 1 else trajs.where(F.col("idx") % lag == 0).withColumn("idx", F.expr(f"idx div {int(lag)}"))


def passages(trajs: DataFrame, in_a: Column, in_b: Column, lag: int = 1, keys=KEYS, block: int | None = None) -> DataFrame:
    """First passages: (keys, idx of arrival, direction AB or BA, fpt, between: rows strictly between the two last-seen states)."""
    rows = strided(trajs, lag).withColumn("lab", macrostate(in_a, in_b))
    if block is not None:
        seen = previous(rows.where("lab is not null").select(*keys, "idx", "lab"), ["idx", "lab"], keys, block)
        turns = seen.where("_prev is null or _prev.lab <> lab").select(*keys, "idx", "lab", F.col("_prev.idx").alias("last_in"))
        rows = previous(turns, ["idx", "lab"], keys, block).where("_prev is not null")
        rows = rows.select(*keys, "idx", F.col("lab").alias("color"), F.col("_prev.lab").alias("before"), "last_in", ((F.col("idx") - F.col("_prev.idx")) * lag).alias("fpt"))
    else:
        w = _by(keys)
        seen = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("color", F.last("lab", ignorenulls=True).over(seen)).withColumn("last_in", F.last(F.when(F.col("lab").isNotNull(), F.col("idx")), ignorenulls=True).over(earlier))
        rows = rows.where("color is not null").withColumn("before", F.lag("color").over(w)).where("before is null or color <> before")
        rows = rows.withColumn("fpt", (F.col("idx") - F.lag("idx").over(w)) * lag).where("before is not null")
    return rows.select(*keys, (F.col("idx") * lag).alias("idx"), F.concat("before", "color").alias("direction"), "fpt", (F.col("idx") - F.col("last_in") - 1).alias("between"))


def mean_passages(found: DataFrame) -> DataFrame:
    """(direction, n, mean, std_err): population standard deviation over the root of n; absent directions have no row."""
    return found.groupBy("direction").agg(F.count("*").alias("n"), F.avg("fpt").alias("mean"), (F.stddev_pop("fpt") / F.sqrt(F.count("*"))).alias("std_err"))


def event_durations(found: DataFrame) -> DataFrame:
    """Durations of transition events: steps, and steps_compat, which counts each row in between twice."""
    return found.select("traj", "idx", "direction", (F.col("between") + 1).alias("steps"), (2 * F.col("between") + 1).alias("steps_compat"))


def paths(trajs: DataFrame, in_a: Column, in_b: Column, keys=KEYS, block: int | None = None) -> DataFrame:
    """Rows of A to B paths: (keys, path_id, idx, in_path, ...): from the first A after the last B to the next B."""
    rows = _coloured(trajs.withColumn("lab", macrostate(in_a, in_b)), keys, block)
    starts = (F.col("color") == "A") & ~F.col("before").eqNullSafe("A")
    closes = (F.col("color") == "B") & F.col("before").eqNullSafe("A")
    one = F.coalesce(starts, F.lit(False)).cast("long")
    if block is None:
        rows = rows.withColumn("path_id", F.sum(one).over(_by(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        rows = _in_blocks(rows, block)
        sums = rows.groupBy(*keys, "_b").agg(F.sum(one).alias("_n"))
        over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carry = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_carry"))
        w = Window.partitionBy(*keys, "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = _joined(rows.withColumn("path_id", F.sum(one).over(w)), carry, keys).withColumn("path_id", F.col("path_id") + F.col("_carry")).drop("_carry", "_b")
    rows = rows.where((F.col("color") == "A") | closes)
    columns = ["path_id", "idx", *[c for c in trajs.columns if c not in (*keys, "idx")]]
    if block is None:
        whole = Window.partitionBy(*keys, "path_id")
        return rows.withColumn("_closed", F.max(closes.cast("int")).over(whole)).where("_closed = 1").select(*keys, *columns)
    ends = rows.where(closes).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, "path_id"])])
    on = F.lit(True)
    for i, c in enumerate([*keys, "path_id"]):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ends, on, "left_semi").select(*keys, *columns)


def path_lengths(found: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, path_id, steps) of paths."""
    return found.groupBy(*keys, "path_id").agg((F.count("*") - 1).alias("steps"))


def count_pairs(trajs: DataFrame, lag: int = 1, sliding: bool = True, keys=KEYS, block: int | None = None) -> DataFrame:
    """(from_state, to_state, n): transitions over lag rows, from every row or from every lag-th."""
    if block is None:
        rows = trajs.withColumn("from_state", F.lag("state", lag).over(_by(keys)))
    else:
        rows = _with_neighbours(trajs, 0, lag, block)
        rows = rows.withColumn("from_state", F.lag("state", lag).over(Window.partitionBy(*keys, "_b").orderBy("idx"))).where("_own")
    rows = rows.where(F.col("idx") >= lag)
    if not sliding:
        rows = rows.where(F.col("idx") % lag == 0)
    return rows.where("from_state is not null and state is not null").groupBy("from_state", F.col("state").alias("to_state")).agg(F.count("*").alias("n"))


def count_array_pairs(rows: DataFrame, states: Column, lag: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by, from_state, to_state, n): transitions over lag places of trajectories kept as one array a row, from every place.

    Nothing but the counts is shuffled. Arrays that are null or have at most lag states have none, nulls are no state.
    """
    n = F.greatest(F.lit(0), F.size(F.col("_states")) - lag)
    pairs = F.arrays_zip(F.slice("_states", F.lit(1), n).alias("from_state"), F.slice("_states", F.lit(1 + lag), n).alias("to_state"))
    flat = rows.select(*by, F.coalesce(states, F.array().cast(rows.select(states).schema[0].dataType)).alias("_states")).select(*by, F.inline(pairs).alias("from_state", "to_state"))
    return flat.where("from_state is not null and to_state is not null").groupBy(*by, "from_state", "to_state").agg(F.count("*").alias("n"))


def symmetrized(counts: DataFrame) -> DataFrame:
    back = counts.select(F.col("to_state").alias("from_state"), F.col("from_state").alias("to_state"), "n")
    return counts.select("from_state", "to_state", "n").unionByName(back).groupBy("from_state", "to_state").agg(F.sum("n").alias("n"))


def normalized(edges: DataFrame, by: list[str], weight: str, name: str = "p") -> DataFrame:
    """edges with their share of the total over by; the totals are grouped and joined, edges being few."""
    return edges.withColumn(name, F.col(weight) / F.sum(weight).over(Window.partitionBy(*by)))


def coloured_counts(trajs: DataFrame, in_a: Column, in_b: Column, lag: int = 1, sliding: bool = True, keys=KEYS, block: int | None = None) -> DataFrame:
    """(from_state, from_color, to_state, to_color, n) at stride lag.

    Rows of one residue of idx are a chain; its first row only lends its state. A pair counts when the colours before
    and after are known from rows of the chain after the first.
    """
    chain = [*keys, "_r"]
    rows = trajs.withColumn("_r", F.col("idx") % lag)
    if not sliding:
        rows = rows.where("_r = 0")
    rows = rows.withColumn("lab", F.when(F.col("idx") >= lag, macrostate(in_a, in_b)))
    if block is None:
        rows = rows.withColumn("from_state", F.lag("state").over(Window.partitionBy(*chain).orderBy("idx")))
    else:
        rows = previous(rows, ["state"], chain, block).withColumn("from_state", F.col("_prev.state")).drop("_prev")
    rows = _coloured(rows, chain, block).withColumnRenamed("before", "from_color")
    rows = rows.where((F.col("idx") >= lag) & F.col("color").isNotNull() & F.col("from_color").isNotNull())
    return rows.groupBy("from_state", "from_color", F.col("state").alias("to_state"), F.col("color").alias("to_color")).agg(F.count("*").alias("n"))


def history_counts(trajs: DataFrame, in_a: Column, in_b: Column, lag: int = 1, history: int = 0, sliding: bool = True, keys=KEYS, block: int | None = None) -> DataFrame:
    """As coloured_counts, with colours known from history rows before the pair only; U stands for unknown."""
    rows = trajs.withColumn("lab", macrostate(in_a, in_b))
    w = _by(keys)
    if block is not None:
        rows, w = _with_neighbours(rows, 0, lag + history, block), Window.partitionBy(*keys, "_b").orderBy("idx")
    rows = rows.withColumn("from_state", F.lag("state", lag).over(w))
    rows = rows.withColumn("from_color", F.last("lab", ignorenulls=True).over(w.rowsBetween(-(lag + history), -lag)))
    if block is not None:
        rows = rows.where("_own")
    rows = rows.withColumn("to_color", F.coalesce("lab", "from_color")).where(F.col("idx") >= lag)
    if not sliding:
        rows = rows.where(F.col("idx") % lag == 0)
    known = lambda c: F.coalesce(F.col(c), F.lit("U")).alias(c)
    return rows.groupBy("from_state", known("from_color"), F.col("state").alias("to_state"), known("to_color")).agg(F.count("*").alias("n"))


def fractional_counts(counts: DataFrame, flux: DataFrame) -> DataFrame:
    """history_counts with unknown colours split in proportion to a flux (from_state, from_color, to_state, to_color, f).

    A pair from an unknown colour into a known one is shared by both colours of its start; where the end is unknown
    too, by all four cells. Pairs that the flux does not know at all are left out. States are few, so the flux is.
    """
    known = counts.where("from_color <> 'U'").select("from_state", "from_color", "to_state", "to_color", F.col("n").cast("double").alias("n"))
    open_ = counts.where("from_color = 'U'").select(F.col("from_state").alias("_f"), F.col("to_state").alias("_t"), F.col("to_color").alias("_c"), "n")
    cells = open_.join(flux, (F.col("_f") == F.col("from_state")) & (F.col("_t") == F.col("to_state")) & ((F.col("_c") == "U") | (F.col("_c") == F.col("to_color"))))
    share = F.col("f") / F.sum("f").over(Window.partitionBy("_f", "_t", "_c"))
    split = cells.where("f > 0").select("from_state", "from_color", "to_state", "to_color", (F.col("n") * share).alias("n"))
    return known.unionByName(split).groupBy("from_state", "from_color", "to_state", "to_color").agg(F.sum("n").alias("n"))


def pseudo_flux(trajs: DataFrame, a: list, b: list, lag: int = 1, sliding: bool = True, keys=KEYS, block: int | None = None) -> DataFrame:
    """(from_state, from_color, to_state, to_color, f): the flux of the reversible Markov chain with colours added.

    a, b: the states of the two macrostates. The chain is solved on the driver, states by states.
    """
    from . import markov as M

    names = [r[0] for r in trajs.select("state").where("state is not null").distinct().orderBy("state").limit(M.LIMIT + 1).collect()]
    at = {s: i for i, s in enumerate(names)}
    if len(names) > M.LIMIT:
        raise ValueError("too many states for a dense matrix")
    w = np.zeros((len(names), len(names)))
    for r in count_pairs(trajs, lag, sliding, keys, block).collect():  # states by states
        w[at[r["from_state"]], at[r["to_state"]]] += r["n"]
    t2 = M.lifted_matrix(M.normalized_rows(w + w.T), [at[s] for s in a if s in at], [at[s] for s in b if s in at])
    f = M.steady_state(t2)[:, None] * t2
    rows = [(names[i // 2], "AB"[i % 2], names[j // 2], "AB"[j % 2], float(f[i, j])) for i, j in zip(*np.nonzero(f), strict=True)]
    kind = trajs.schema["state"].dataType.simpleString()
    return trajs.sparkSession.createDataFrame(rows, f"from_state {kind}, from_color string, to_state {kind}, to_color string, f double")


def history_model(trajs: DataFrame, a: list, b: list, lag: int = 1, history: int = 0, sliding: bool = True, keys=KEYS, block: int | None = None) -> DataFrame:
    """Coloured counts with finite history, unknown colours split by the flux of the chain with colours added."""
    counts = history_counts(trajs, F.col("state").isin(a), F.col("state").isin(b), lag, history, sliding, keys, block)
    return fractional_counts(counts.where("from_state is not null and to_state is not null"), pseudo_flux(trajs, a, b, lag, sliding, keys, block))


def correlation(trajs: DataFrame, in_a: Column, in_b: Column, lags: list[int], symmetric: bool = False, keys=KEYS, block: int | None = None) -> DataFrame:
    """(delta, p): share of row pairs delta apart that start in A and end in B; symmetric: either order, averaged."""
    w = _by(keys)
    rows = trajs.withColumn("a", in_a.cast("int")).withColumn("b", in_b.cast("int"))
    if block is not None:
        rows, w = _with_neighbours(rows, max(lags), 0, block), Window.partitionBy(*keys, "_b").orderBy("idx")
    parts = []
    for d in lags:
        ahead = F.lead("b", d).over(w)
        back = F.lead("a", d).over(w)
        parts.append(F.struct(F.lit(d).cast("long").alias("delta"), (F.col("a") * ahead).alias("ab"), (F.col("b") * back).alias("ba")))
    rows = rows.withColumn("_p", F.array(*parts))
    if block is not None:
        rows = rows.where("_own")
    rows = rows.select(F.inline("_p")).where("ab is not null")
    p = (F.avg("ab") + F.avg("ba")) / 2 if symmetric else F.avg("ab")
    return rows.groupBy("delta").agg(p.alias("p"))


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place by order, from 0, numbered range by range: no task sees all rows.

    order must leave no ties. Only the sizes of the ranges, one for each partition, meet in a window and are broadcast.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.join(F.broadcast(starts), "_part").withColumn(name, place.cast("long")).drop("_part", "_first")


def dictionary(trajs: DataFrame) -> DataFrame:
    """(label, code): numbers for state labels in the order in which trajectories first show them."""
    first = trajs.groupBy(F.col("state").alias("label")).agg(F.min(F.struct("traj", "idx")).alias("at"))
    return ranked(first, [F.col("at"), F.col("label")], "code").select("label", "code")


def path_counts(found: DataFrame, keys=KEYS) -> DataFrame:
    """(path, n, weight): equal sequences of states, with their share of all."""
    seqs = found.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "state"))), lambda s: s["state"].cast("string")), ">").alias("path"))
    counts = seqs.groupBy("path").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("path", "n", (F.col("n") / F.col("total")).alias("weight"))


def joined_ensembles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trajectories of both; those of b get names that don't clash."""
    if len(a.columns) != len(b.columns):
        raise ValueError("the ensembles differ in dimensions")
    tag = lambda d, n: d.withColumn("traj", F.concat(F.lit(n), F.col("traj").cast("string")))
    return tag(a, "a:").unionByName(tag(b, "b:"))


def shape_of(trajs: DataFrame, column: str = "x", keys=KEYS) -> DataFrame:
    """(keys, n_snapshots, n_variables) of each trajectory; column is a number or an array of numbers, nothing deeper."""
    kind = trajs.schema[column].dataType.simpleString()
    if kind.startswith("array<array") or kind.startswith(("map", "struct")):
        raise ValueError("a trajectory has one or two dimensions")
    size = F.max(F.size(column)) if kind.startswith("array") else F.lit(1)
    return trajs.groupBy(*keys).agg(F.count("*").alias("n_snapshots"), size.cast("long").alias("n_variables"))


def sorted_together(rows: DataFrame, by: str, *others: str) -> DataFrame:
    """Columns in the order of the first, largest first; equal ones by the others, so that the order is fixed."""
    return rows.select(by, *others).orderBy(F.desc(by), *others)
