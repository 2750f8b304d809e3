"""Histories of segments to any depth, by doubling.

A segment (keys, n_iter, seg_id, parent_id) points to its parent, the segment parent_id of the iteration before in the
same keys; a negative parent_id marks a recycled walker, where a history ends: that segment is its root. A pointer over
2 d steps is two pointers over d steps, so depth D takes about log2(D) joins of narrow tables, each kept before it is
joined with itself. Histories that have ended leave the joins, so that their null pointers do not meet in one task.

Defined results: a repeated segment counts once, with its smallest parent; a null parent and a parent that the table
lacks end a history without a root; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import kept

KEYS = ("file_idx",)


def joined(rows: DataFrame, side: DataFrame, keys: Sequence[str], back: int | Column, pointer: str, take: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with columns take of the segment that pointer names, back iterations before; side has (keys, n_iter, seg_id, take)."""
    names = [*keys, "n_iter", "seg_id", *take]
    other = side.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(names)])
    n = len(keys)
    on = (F.col("n_iter") - back == F.col(f"_r{n}")) & (F.col(pointer) == F.col(f"_r{n + 1}"))
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    left = [c for c in rows.columns if c not in take]
    return rows.join(other, on, how).select(*left, *[F.col(f"_r{n + 2 + i}").alias(c) for i, c in enumerate(take)])


def _pointers(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return segments.groupBy(*keys, "n_iter", "seg_id").agg(F.min("parent_id").alias("parent_id"))


def _one_on(rows: DataFrame, d: int) -> DataFrame:
    """From d steps back to d + 1: at becomes the parent, or the root is found d steps back."""
    ends = F.col("at").isNotNull() & (F.col("up") < 0)
    names = [c for c in rows.columns if c not in ("at", "up", "root_steps", "root")]
    steps = F.when(ends, F.lit(d)).otherwise(F.col("root_steps")).cast("long")
    return rows.select(*names, F.when(F.col("up") >= 0, F.col("up")).alias("at"), steps.alias("root_steps"), F.when(ends, F.col("at")).otherwise(F.col("root")).alias("root"))


def ancestors(segments: DataFrame, depth: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_iter, seg_id, ancestor, root_steps, root): the segment depth iterations back, or the root met before.

    ancestor is null where the history is shorter; it may name a segment that the table lacks. root is the recycled
    segment less than depth steps back, root_steps how many; both are null if there is none.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    none, names = F.lit(None).cast("long"), [*keys, "n_iter", "seg_id"]
    # at: the segment d steps back, up: its parent as stored; at is null as soon as a root is found.
    rows = _pointers(segments, keys).select(*names, F.col("seg_id").cast("long").alias("at"), F.col("parent_id").cast("long").alias("up"), none.alias("root_steps"), none.alias("root"))
    d = 0
    for bit in f"{depth - 1:b}" if depth > 1 else "":
        rows, over = kept(rows, "ancestors"), int(bit)
        here = _one_on(rows, d) if over else rows.drop("up")
        live = here.where("at is not null").select(*names, F.col("at").alias("via"))
        far = joined(live, rows, keys, d + over, "via", ["at", "up", "root_steps", "root"], "left").drop("via")
        ended = here.where("at is null").select(*names, "at", none.alias("up"), "root_steps", "root")
        rows = far.withColumn("root_steps", F.col("root_steps") + (d + over)).unionByName(ended)
        d = 2 * d + over
    return _one_on(rows, d).withColumnRenamed("at", "ancestor")


def ancestry(segments: DataFrame, depth: int, keys: Sequence[str] = KEYS, start: Column | None = None) -> DataFrame:
    """(keys, n_iter, seg_id, step, ancestor): a row for each ancestor up to depth iterations back, the segment itself as step 0.

    start: which segments' histories are asked for (all by default). Pointers over 1, 2, 4, ... steps are made first;
    then each kind, the longest first, adds to every row the one that many steps on, so that rows double with each join.
    The last ancestor of a history may be one that the table lacks.
    """
    names = [*keys, "n_iter", "seg_id"]
    own = _pointers(segments, keys)
    jumps = [kept(own.where("parent_id >= 0").select(*names, F.col("parent_id").cast("long").alias("up")), "ancestry")]
    while 2 << (len(jumps) - 1) <= depth:
        here = jumps[-1].withColumnRenamed("up", "via")
        jumps.append(kept(joined(here, jumps[-1], keys, 1 << (len(jumps) - 1), "via", ["up"]).drop("via"), "ancestry"))
    out = own if start is None else own.where(start)
    out = out.select(*names, F.lit(0).alias("step"), F.col("seg_id").cast("long").alias("ancestor"))
    for k in reversed(range(len(jumps))):
        more = out.where(F.col("step") + (1 << k) <= depth)
        more = joined(more, jumps[k], keys, F.col("step"), "ancestor", ["up"])
        more = more.select(*names, (F.col("step") + (1 << k)).cast("int").alias("step"), F.col("up").alias("ancestor"))
        out = kept(out.unionByName(more), "ancestry")
    return out


def history_sums(segments: DataFrame, depth: int, values: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_iter, seg_id, n, values): of each segment's history up to depth iterations back, itself included, the segments and
    their summed values.

    Sums over d segments double with their pointers, so the rows stay one for each segment, whatever depth is. Repeated
    segments have one history, by their smallest parent, in which each counts; nulls add nothing, and the sum of nulls
    alone is null.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    names, sums = [*keys, "n_iter", "seg_id"], [f"_s{i}" for i in range(len(values) + 1)]
    parts = [F.count("*"), *[F.sum(v) for v in values]]
    own = segments.groupBy(*names).agg(F.min("parent_id").cast("long").alias("_up"), *[x.alias(s) for x, s in zip(parts, sums, strict=True)])
    # _at: the segment d steps back; _s: sums over the d segments before it; _o: the segment's own.
    rows = own.select(*names, F.when(F.col("_up") >= 0, F.col("_up")).alias("_up"), *[F.col(s).alias(s.replace("s", "o")) for s in sums], *sums)
    rows = kept(rows.withColumn("_at", F.col("_up")), "sums")

    def added(side: DataFrame, pointer: str, d: int, begin: str) -> DataFrame:
        """rows with the sums of side's segment that pointer names, d iterations back, added to the columns named from begin."""
        far = side.select(*names, F.col("_at").alias("_far"), *[F.col(s).alias(s.replace("s", "t")) for s in sums])
        live = joined(rows.where(F.col(pointer).isNotNull()), far.hint("merge"), keys, d, pointer, ["_far", *[s.replace("s", "t") for s in sums]], "left")
        both = []
        for s in sums:
            a, b = F.col(s.replace("s", begin)), F.col(s.replace("s", "t"))
            both.append(F.coalesce(a + b, a, b).alias(s))
        stay = [c for c in rows.columns if c not in (*sums, "_at")]
        ended = rows.where(F.col(pointer).isNull()).select(*stay, *[F.col(s.replace("s", begin)).alias(s) for s in sums], F.lit(None).cast("long").alias("_at"))
        return kept(live.select(*stay, *both, F.col("_far").alias("_at")).unionByName(ended), "sums")

    d = 1
    for bit in f"{depth + 1:b}"[1:]:
        rows = added(rows, "_at", d, "s")
        d *= 2
        if int(bit):
            rows = added(rows, "_up", 1, "o")
            d += 1
    return rows.select(*names, F.col("_s0").alias("n"), *[F.col(s).alias(v) for s, v in zip(sums[1:], values, strict=True)])
