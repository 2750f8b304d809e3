"""Equal sequences of states found and counted without a whole path in one row or task.

Every row of a path is numbered by its place and hashed with it; the hashes of a path add up to its signature, so the sum
is made before the shuffle and any path is spread over as many tasks as it has blocks. Paths of one signature and length
are compared row by row with the first of them; should one differ, signatures are made anew with another seed. What is
returned is therefore exact.

Rows without a state are left out, as are paths that have no other. Rows with equal idx are ordered by state. Null keys are
keys. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import kept

from .trajectories import BLOCK, KEYS, from_log

PARTS = [f"s{i}" for i in range(4)]


def placed(found: DataFrame, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """(path, place, state) of rows (keys, idx, state): path is a struct of the keys, places count from 0 without gaps."""
    rows = found.where("state is not null").select(F.struct(*keys).alias("path"), "idx", F.col("state").cast("string").alias("state"))
    return from_log(rows, "path", ["idx", "state"], F.expr(f"idx div {int(block)}"), state="state").select(F.col("traj").alias("path"), F.col("idx").alias("place"), "state")


def signatures(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(path, length, s0 .. s3): 128 bits of hashes of place and state, added up in halves of 32 bits."""
    sums = []
    for i in range(2):
        h = F.xxhash64("place", "state", F.lit(2 * seed + i))
        sums += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))]
    return rows.groupBy("path").agg(F.count("*").alias("length"), *[s.alias(n) for s, n in zip(sums, PARTS, strict=True)])


def grouped(rows: DataFrame, seeds: int = 8) -> DataFrame:
    """(path, first): each path with the smallest path of the same sequence; rows are those of placed()."""
    for seed in range(seeds):
        signed = kept(signatures(rows, seed), "sequences")
        heads = signed.groupBy("length", *PARTS).agg(F.min("path").alias("first"))
        named = kept(signed.join(heads, ["length", *PARTS]).select("path", "first"), "sequences")
        others = rows.join(named.where("path <> first"), "path").select("first", "place", "state")
        firsts = named.where("path = first").select("path")
        own = rows.join(firsts, "path", "left_semi").select(F.col("path").alias("first"), "place", F.col("state").alias("own"))
        if others.join(own, ["first", "place"], "left").where("own is null or own <> state").isEmpty():
            return named
    raise ArithmeticError(f"sequences that differ have equal signatures for {seeds} seeds")


def sequence_counts(found: DataFrame, keys: Sequence[str] = KEYS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(counts, states): counts has a row (keys, length, n, weight) for each different sequence, named by the smallest path
    that has it; states has its rows (keys, place, state). weight is the share of all paths."""
    rows = kept(placed(found, keys, block), "sequences")
    named = grouped(rows)
    counts = named.groupBy("first").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    lengths = rows.groupBy("path").agg(F.count("*").alias("length"))
    counts = counts.join(lengths, F.col("first") == F.col("path")).crossJoin(F.broadcast(total))
    counts = kept(counts.select("first", "length", "n", (F.col("n") / F.col("total")).alias("weight")), "sequences")
    states = rows.join(counts.select(F.col("first").alias("path")), "path", "left_semi")
    return counts.select("first.*", "length", "n", "weight"), states.select("path.*", "place", "state")
