"""The state of a model kept batch by batch: moments of reductions and sums of flux, for each iteration.

Both are additive. A batch writes its sums for each iteration that it holds into a partition of its own, which is
replaced if the batch is repeated. A model is made from all batches' sums from some iteration on: older ones are
forgotten by leaving their rows out, without a look at the data. What is kept grows with batches and iterations, not
with segments; compacted() makes one batch of many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import reduce as R

MOMENTS = f"n_iter bigint, {R.PACKED}, batch bigint"
FLUX = "n_iter bigint, from_state bigint, to_state bigint, w double, batch bigint"


def keep_moments(path: str, d: int, both: bool = True) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over segments (n_iter, x, y, weight) of d coordinates: PACKED sums of each iteration."""

    def take(batch: DataFrame, number: int) -> None:
        R.packed_moments(batch, d, both, "n_iter").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return take


def moments_since(spark: SparkSession, path: str, d: int, first: int | None = None, both: bool = True) -> dict:
    """moments() of all batches kept at path, of iterations from first on; for pca_of, tica_of and vamp_of."""
    rows = spark.read.schema(MOMENTS).parquet(path)
    return R.moments(rows if first is None else rows.where(F.col("n_iter") >= first), d, both)


def keep_flux(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over segments (n_iter, from_state, to_state, weight): summed flux of each iteration."""

    def take(batch: DataFrame, number: int) -> None:
        rows = batch.where("n_iter is not null and from_state is not null and to_state is not null")
        sums = rows.groupBy(*[F.col(c).cast("long").alias(c) for c in ("n_iter", "from_state", "to_state")]).agg(F.sum("weight").alias("w"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return take


def flux_since(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(from_state, to_state, w): flux an iteration, over iterations from first on that have any."""
    rows = spark.read.schema(FLUX).parquet(path)
    rows = rows if first is None else rows.where(F.col("n_iter") >= first)
    n = rows.agg(F.count_distinct("n_iter").alias("n"))
    sums = rows.groupBy("from_state", "to_state").agg(F.sum("w").alias("w"))
    return sums.crossJoin(F.broadcast(n)).select("from_state", "to_state", (F.col("w") / F.col("n")).alias("w"))


def compacted(spark: SparkSession, path: str, target: str, schema: str = FLUX) -> None:
    """All batches kept at path as batch -1 at target, with the same sums: flux added up, moments side by side."""
    rows = spark.read.schema(schema).parquet(path)
    if schema == FLUX:
        rows = rows.groupBy("n_iter", "from_state", "to_state").agg(F.sum("w").alias("w"))
    else:
        rows = rows.drop("batch")
    rows.write.mode("overwrite").parquet(f"{target}/batch=-1")
