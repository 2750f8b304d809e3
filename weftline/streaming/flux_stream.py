"""Flux and first passages over unbounded streams of segments and snapshots.

Flux is an additive aggregate, so edges are a running grouped sum. Passage times need each trajectory's last colour
and the index of its last change: a few values of state for each trajectory, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.trajectories import macrostate


def flux_edges(stream: DataFrame) -> DataFrame:
    """(from_state, to_state, w) so far; for output mode complete or update."""
    return stream.groupBy("from_state", "to_state").agg(F.sum("weight").alias("w"))


def windowed_edges(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Edges for each window of event time; rows later than late are dropped and closed windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "from_state", "to_state").agg(F.sum("weight").alias("w"))


PASSED = "traj bigint, idx bigint, direction string, fpt bigint"
STATE = "color string, changed bigint"


def passages(stream: DataFrame, in_a: Column, in_b: Column) -> DataFrame:
    """First passages of trajectories (traj, idx, ...) as they come; a trajectory's rows must arrive in order of idx
    (within a batch they are sorted)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = stream.select("traj", "idx", macrostate(in_a, in_b).alias("lab")).where("lab is not null")

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        pdf = pd.concat(list(batches)).sort_values("idx")
        color, changed = state.get if state.exists else (None, 0)
        out = []
        for idx, lab in zip(pdf["idx"].tolist(), pdf["lab"].tolist(), strict=True):
            if lab == color:
                continue
            if color is not None:
                out.append((key[0], idx, color + lab, idx - changed))
            color, changed = lab, idx
        state.update((color, changed))
        yield pd.DataFrame(out, columns=["traj", "idx", "direction", "fpt"])

    return rows.groupBy("traj").applyInPandasWithState(step, PASSED, STATE, "append", GroupStateTimeout.NoTimeout)
