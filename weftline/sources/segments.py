"""Weighted trajectory segments: sources, selections and lineage.

A segment is a row (file_idx, n_iter, seg_id, weight, parent_id, endpoint_type, pcoord0, pcoord1, coord0, coord1); a
negative parent_id marks a recycled walker. Tables are Parquet, best partitioned by n_iter, so that iterations are
picked by partition pruning and coordinates are only read where they are selected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.predicates import has_nan

from . import lineage

RECYCLED = 3  # fixed value: endpoint type of a recycled walker in the simulation's tables

SEGMENTS = T.StructType([
    T.StructField("file_idx", T.IntegerType()),
    T.StructField("n_iter", T.IntegerType()),
    T.StructField("seg_id", T.LongType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("parent_id", T.LongType()),
    T.StructField("endpoint_type", T.IntegerType()),
    T.StructField("pcoord0", T.ArrayType(T.DoubleType())),
    T.StructField("pcoord1", T.ArrayType(T.DoubleType())),
    T.StructField("coord0", T.ArrayType(T.DoubleType())),
    T.StructField("coord1", T.ArrayType(T.DoubleType())),
])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path).select(*SEGMENTS.names)  # folders put n_iter last


def write_segments(segments: DataFrame, path: str) -> None:
    """The sink for collected coordinates: one folder for each iteration."""
    segments.repartition("n_iter").write.partitionBy("n_iter").mode("overwrite").parquet(path)


def complete(segments: DataFrame) -> DataFrame:
    """Without the last iteration of each file, which may be unfinished: a maximum for each file, joined back."""
    last = segments.groupBy("file_idx").agg(F.max("n_iter").alias("_last"))
    return segments.join(F.broadcast(last), "file_idx").where("n_iter < _last").drop("_last")


def iteration(segments: DataFrame, n_iter: int) -> DataFrame:
    """One iteration's segments over all files, of complete iterations only."""
    last = segments.groupBy("file_idx").agg(F.max("n_iter").alias("_last"))
    return segments.where(F.col("n_iter") == n_iter).join(F.broadcast(last), "file_idx").where("n_iter < _last").drop("_last")


def iteration_counts(segments: DataFrame) -> DataFrame:
    """(n_iter, n_segments) from iteration 1 up to the first that has none; the numbers of iterations are few."""
    counts = segments.groupBy("n_iter").agg(F.count("*").alias("n_segments"))
    w = Window.orderBy("n_iter")
    return counts.withColumn("_at", F.row_number().over(w)).where("n_iter = _at").drop("_at")


def iterations_between(segments: DataFrame, first: int, last: int) -> DataFrame:
    """Counts over an explicit range of iterations, both ends included."""
    return segments.where(F.col("n_iter").between(first, last)).groupBy("n_iter").agg(F.count("*").alias("n_segments"))


def pick_iterations(segments: DataFrame, first: int | None = None, last: int | None = None, iters: Sequence[int] | None = None) -> DataFrame:
    """Iterations first <= n_iter < last, or those listed; both is an error."""
    if iters is not None and (first is not None or last is not None):
        raise ValueError("give either a range or a list of iterations")
    if iters is not None:
        return segments.where(F.col("n_iter").isin([int(i) for i in iters]))
    out = segments
    if first is not None:
        out = out.where(F.col("n_iter") >= first)
    if last is not None:
        out = out.where(F.col("n_iter") < last)
    return out


def end_coordinates(segments: DataFrame) -> DataFrame:
    """Coordinates at the end of each segment, without bad segments."""
    return segments.where(~has_nan(F.col("coord1"))).select("file_idx", "n_iter", "seg_id", "coord1")


def start_coordinates(segments: DataFrame) -> DataFrame:
    """Coordinates at the start of each segment, without bad segments."""
    return segments.where(~has_nan(F.col("coord0"))).select("file_idx", "n_iter", "seg_id", "coord0")


def coordinate_set(segments: DataFrame, first: int, last: int) -> DataFrame:
    """(file_idx, n_iter, seg_id, pcoord1, coord1) of iterations first <= n_iter < last, for reductions and clusters.

    A bad segment's progress coordinates are NaN and its structure is null, so that rows stay those of the segments.
    """
    rows = pick_iterations(segments, first, last)
    good = ~has_nan(F.col("coord1"))
    nan = F.transform("pcoord1", lambda x: F.lit(float("nan")))
    return rows.select("file_idx", "n_iter", "seg_id", F.when(good, F.col("pcoord1")).otherwise(nan).alias("pcoord1"), F.when(good, F.col("coord1")).alias("coord1"))


def label_parts(label: Column, pattern: str, n: int) -> list[Column]:
    """The whole numbers that a label's n groups hold, null where the label does not fit the pattern."""
    return [F.when(label.rlike(pattern), F.regexp_extract(label, pattern, k).cast("bigint")) for k in range(1, n + 1)]


def transition_pairs(segments: DataFrame) -> DataFrame:
    """(start, end, weight) of each segment; a segment with NaN coordinates weighs nothing."""
    bad = has_nan(F.col("coord0")) | has_nan(F.col("coord1"))
    return segments.select("file_idx", "n_iter", "seg_id", F.col("coord0").alias("start"), F.col("coord1").alias("end"), F.when(bad, 0.0).otherwise(F.col("weight")).alias("weight"))


def masked_pcoords(segments: DataFrame) -> DataFrame:
    """Progress coordinates in iteration order with NaN for bad segments."""
    nan = F.transform("pcoord1", lambda x: F.lit(float("nan")))
    return segments.select("file_idx", "n_iter", "seg_id", F.when(has_nan(F.col("coord1")), nan).otherwise(F.col("pcoord1")).alias("pcoord1"))


def histories(segments: DataFrame, depth: int, keys: Sequence[str] = ("file_idx",), carry: Sequence[str] = ("weight",)) -> DataFrame:
    """Each segment with its ancestors up to depth iterations back: parent_k and the carried columns_k, k = 1 .. depth.

    A chain ends, with nulls, at a negative parent. Each step is an equi-join on (keys, n_iter - k, seg_id).
    """
    out = segments.withColumn("_up", F.col("parent_id"))
    for k in range(1, depth + 1):
        older = segments.select(*[F.col(c).alias(f"_{c}") for c in keys], (F.col("n_iter") + k).alias("_iter"), F.col("seg_id").alias("_seg"), F.col("parent_id").alias("_next"), *[F.col(c).alias(f"{c}_{k}") for c in carry])
        on = (F.col("n_iter") == F.col("_iter")) & (F.col("_up") == F.col("_seg")) & (F.col("_up") >= 0)
        for c in keys:
            on = on & (F.col(c) == F.col(f"_{c}"))
        out = out.join(older, on, "left").withColumn(f"parent_{k}", F.col("_seg")).withColumn("_up", F.col("_next"))
        out = out.drop("_iter", "_seg", "_next", *[f"_{c}" for c in keys])
    return out.drop("_up")


def lagged_pairs(segments: DataFrame, n_lag: int, basis: Column, reference: Column, keys: Sequence[str] = ("file_idx",)) -> DataFrame:
    """(start, end, weight) over n_lag parents; a walker recycled on the way gives two.

    One is from the basis to its end, with its weight. The other is from the structure before the warp to the
    reference, with the weight that the walker had where it was recycled. A history ends at a warp, and what it then
    points to n_lag iterations back is the first segment of that iteration in its file: that one's start is the
    structure before the warp. basis and reference: coordinate columns (literals) of the two structures.

    Ancestors come by doubling (lineage.ancestors), so the joins grow with the logarithm of n_lag.
    """
    if n_lag == 0:
        return transition_pairs(segments).select("start", "end", "weight")
    narrow = segments.select(*keys, "n_iter", "seg_id", "parent_id")
    found = lineage.ancestors(narrow, n_lag, keys)
    rows = lineage.joined(segments.select(*keys, "n_iter", "seg_id", "coord1", "weight"), found, keys, 0, "seg_id", ["ancestor", "root_steps", "root"])
    starts = segments.select(*keys, "n_iter", "seg_id", F.col("coord0").alias("start"))
    plain = lineage.joined(rows.where("root_steps is null and ancestor is not null"), starts, keys, n_lag, "ancestor", ["start"])
    plain = plain.where("start is not null").select("start", F.col("coord1").alias("end"), "weight")
    weights = segments.select(*keys, "n_iter", "seg_id", F.col("weight").alias("_warp"))
    recycled = lineage.joined(rows.where("root_steps is not null"), weights, keys, F.col("root_steps"), "root", ["_warp"])
    first = segments.groupBy(*[F.col(c).alias(f"_{c}") for c in keys], (F.col("n_iter") + n_lag).alias("_iter")).agg(F.min_by("coord0", "seg_id").alias("_before"))
    on = F.col("n_iter") == F.col("_iter")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    before = recycled.join(first, on).select(F.col("_before").alias("start"), reference.alias("end"), F.col("_warp").alias("weight"))
    return plain.unionByName(recycled.select(basis.alias("start"), F.col("coord1").alias("end"), "weight")).unionByName(before)


def trajectories(segments: DataFrame, from_iter: int, length: int) -> DataFrame:
    """Coordinates along the histories of one iteration's segments: (file_idx, seg_id, steps array of (n_iter, coord)).

    Only the iterations on the way are read; a history has at most length steps, so an array has, too.
    """
    rows = segments.where(F.col("n_iter").between(from_iter - length + 1, from_iter))
    paths = lineage.ancestry(rows.select("file_idx", "n_iter", "seg_id", "parent_id"), length - 1, start=F.col("n_iter") == from_iter)
    steps = lineage.joined(paths, rows.select("file_idx", "n_iter", "seg_id", "coord1"), ("file_idx",), F.col("step"), "ancestor", ["coord1"])
    step = F.struct((F.col("n_iter") - F.col("step")).alias("n_iter"), F.col("coord1").alias("coord"))
    return steps.where("coord1 is not null").groupBy("file_idx", "seg_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def target_reached(segments: DataFrame) -> bool:
    """Whether any complete iteration has a recycled endpoint; stops at the first one found."""
    return not complete(segments).where(F.col("endpoint_type") == RECYCLED).limit(1).isEmpty()


def with_parent_coordinates(segments: DataFrame, basis: Column, keys: Sequence[str] = ("file_idx",)) -> DataFrame:
    """Start coordinates from the parent's end, or from the basis structure where there is no parent."""
    older = segments.select(*[F.col(c).alias(f"_{c}") for c in keys], (F.col("n_iter") + 1).alias("_iter"), F.col("seg_id").alias("_seg"), F.col("coord1").alias("_coord"))
    on = (F.col("n_iter") == F.col("_iter")) & (F.col("parent_id") == F.col("_seg"))
    for c in keys:
        on = on & (F.col(c) == F.col(f"_{c}"))
    joined = segments.drop("coord0").join(older, on, "left").withColumn("coord0", F.coalesce("_coord", basis))
    return joined.select(*segments.columns)


def until_budget(segments: DataFrame, budget: int) -> DataFrame:
    """The latest iterations, backwards until they hold at least budget segments."""
    counts = segments.groupBy("n_iter").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n_iter")).rowsBetween(Window.unboundedPreceding, -1)
    picked = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < budget).select("n_iter")
    return segments.join(F.broadcast(picked), "n_iter", "left_semi")


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of a structure file: serial, name, res_name, res_seq, x, y, z (fixed columns of the format)."""
    text = lambda a, n: F.trim(F.substring("value", a, n))
    rows = spark.read.text(path).where(F.rtrim(F.substring("value", 1, 6)).isin("ATOM", "HETATM"))
    return rows.select(text(7, 5).cast("int").alias("serial"), text(13, 4).alias("name"), text(18, 3).alias("res_name"), text(23, 4).cast("int").alias("res_seq"), text(31, 8).cast("double").alias("x"), text(39, 8).cast("double").alias("y"), text(47, 8).cast("double").alias("z"))


def read_structure(spark: SparkSession, source: str | dict) -> DataFrame:
    """(serial, x array) of a topology or basis structure: a .pdb file, a text file of numbers, or {"coords": rows}."""
    if isinstance(source, dict):
        rows = [(i, [float(v) for v in (x if hasattr(x, "__len__") else [x])]) for i, x in enumerate(source["coords"], 1)]
        return spark.createDataFrame(rows, "serial int, x array<double>")
    if source.endswith(".pdb"):
        return read_pdb(spark, source).select("serial", F.array("x", "y", "z").alias("x"))
    # Such a file is one structure; its lines are numbered as one file is read.
    rows = spark.read.text(source, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda v: (F.trim(v) != "") & ~F.trim(v).startswith("#"))).alias("k", "line"))
    return rows.select((F.col("k") + 1).alias("serial"), F.transform(F.split(F.trim("line"), r"[\s,]+"), lambda v: v.cast("double")).alias("x"))


def write_values(rows: DataFrame, order: str, column: str, path: str) -> None:
    """A text sink: one number for each line in scientific form, in order; for vectors over states, which are few."""
    rows.coalesce(1).sortWithinPartitions(order).select(F.format_string("%.18e", F.col(column)).alias("value")).write.mode("overwrite").text(path)


def write_states(rows: DataFrame, path: str) -> None:
    """Start, basis or target states (label, weight, ref) as lines "label weight ref", in order of their labels."""
    line = F.concat_ws(" ", F.col("label").cast("string"), F.col("weight").cast("string"), F.col("ref"))
    rows.orderBy("label").select(line.alias("value")).write.mode("overwrite").text(path)


def structures_by_state(segments: DataFrame, state: str = "to_state") -> DataFrame:
    """(state, n_iter, file_idx, seg_id, weight) of all structures, but those of the last two iterations; kept long."""
    last = segments.agg(F.max("n_iter").alias("_last"))
    rows = segments.crossJoin(F.broadcast(last)).where((F.col("n_iter") >= 1) & (F.col("n_iter") < F.col("_last") - 1))
    return rows.where(F.col(state).isNotNull()).select(F.col(state).alias("state"), "n_iter", "file_idx", "seg_id", "weight")


def first_filled(points: DataFrame, least: int) -> DataFrame:
    """(first): the latest iteration from which on every bin that is seen holds at least least points, else the first.

    Iterations are pulled from the last one back. A bin spoils every start after which it is seen but not yet filled;
    the table of bins and iterations is small beside the points (n_iter, bin).
    """
    counts = points.groupBy("bin", "n_iter").agg(F.count("*").alias("n"))
    w = Window.partitionBy("bin").orderBy(F.desc("n_iter"))
    run = counts.withColumn("have", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bins = run.groupBy("bin").agg(F.max("n_iter").alias("seen"), F.max(F.when(F.col("have") >= least, F.col("n_iter"))).alias("full"))
    iters = counts.select("n_iter").distinct()
    spoilt = iters.join(bins, (F.col("n_iter") <= F.col("seen")) & (F.col("full").isNull() | (F.col("n_iter") > F.col("full"))), "left_anti")
    least_iter = iters.agg(F.min("n_iter").alias("_min"))
    return spoilt.agg(F.max("n_iter").alias("_max")).crossJoin(F.broadcast(least_iter)).select(F.coalesce("_max", "_min").alias("first"))


def fill_bins(points: DataFrame, least: int) -> DataFrame:
    """The points from first_filled() on."""
    return points.join(F.broadcast(first_filled(points, least)), F.col("n_iter") >= F.col("first")).drop("first")


def structure_reference(file: Column, n_iter: Column, seg_id: Column) -> Column:
    """A structure named by where it is stored."""
    return F.concat_ws(":", F.lit("hdf"), file, n_iter.cast("string"), seg_id.cast("string"))
