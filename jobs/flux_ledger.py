"""Flux ledger, incremental: the flux matrix of a growing run of snapshots, kept current one day at a time.

A run writes snapshots (event_id, ts, user_id, event_type, value): user_id is the walker, event_type the cluster of the
snapshot, value its progress coordinate. A day is an iteration. Consecutive snapshots of a walker are a segment, which
belongs to the day of its end; a day's segments share the weight 1. A snapshot in the basis box is the state after the
last cluster, one in the target box the next (as in weftline.operators.flux). Segments with an end in no state (an
unknown or null event_type outside of both boxes) weigh, but are no flux between states.

Tables in the output folder:
  ledger/day=...      from_state, to_state, w (the day's flux), total (flux up to and with the day), p (share of total in
                      what left from_state up to and with the day); a row for each pair of states seen on the day
  totals/upto=...     flux of each pair up to the mark
  walkers/upto=...    each walker's last snapshot up to the mark
  marks               upto: a row for each finished run

The last day of the input may be unfinished and waits for the next run. A run reads the snapshots of closed days beyond
the mark and the walkers' last ones, replaces exactly those days' partitions and sets the mark last: a run that is
repeated, after success or in the middle, gives the same tables. Snapshots that come for days up to the mark are not
seen. Rows without ts are left out; a null user_id is a walker of its own.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line, found, logger
from weftline.operators import flux, trajectories

SNAPSHOTS = ["event_id", "ts", "user_id", "event_type", "value"]
TOTALS = "from_state bigint, to_state bigint, total double"
LEDGER = "from_state bigint, to_state bigint, w double, total double, p double, day date"
log = logger("flux_ledger")


def segments(snapshots: DataFrame, clusters: list[str]) -> DataFrame:
    """(day, from_cluster, to_cluster, p0, p1, weight) of consecutive snapshots of a walker, by the day of their end."""
    rows = snapshots.withColumn("day", F.to_date("ts"))
    rows = trajectories.previous_in(rows, ["value", "event_type"], ["user_id"], F.col("day"), ["ts", "event_id"]).where("_prev is not null")
    number = lambda c: F.nullif(F.array_position(F.array(*[F.lit(x) for x in clusters]), c), F.lit(0)).cast("long") - 1
    return rows.select("day", number(F.col("_prev.event_type")).alias("from_cluster"), number(F.col("event_type")).alias("to_cluster"), F.col("_prev.value").alias("p0"), F.col("value").alias("p1"))


def daily_flux(rows: DataFrame, n: int, basis: list[float], target: list[float]) -> DataFrame:
    """(day, from_state, to_state, w) of segments; a day's segments share the weight 1."""
    rows = flux.with_states(rows, n, basis, target).withColumn("weight", F.lit(1.0))
    edges = trajectories.normalized(flux.flux_matrix(rows, by=("day",)), ["day"], "w", "w")
    return edges.where("from_state is not null and to_state is not null")


def with_totals(edges: DataFrame, before: DataFrame, day: Column) -> DataFrame:
    """LEDGER rows of edges (day, from_state, to_state, w); before holds the totals up to some earlier day."""
    old = before.select(day.alias("day"), "from_state", "to_state", F.col("total").alias("w"), F.lit(True).alias("old"))
    rows = edges.select("day", "from_state", "to_state", "w", F.lit(False).alias("old")).unionByName(old)
    so_far = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("w").over(so_far.partitionBy("from_state", "to_state"))
    left = F.sum("w").over(so_far.partitionBy("from_state"))
    return rows.select("from_state", "to_state", "w", total.alias("total"), (total / left).alias("p"), "day", "old").where("not old").drop("old")


def run(spark: SparkSession, config: dict) -> dict:
    """Brings the tables in config["output"] up to the last closed day of config["input"]; returns what it read and wrote."""
    out = config["output"].rstrip("/")
    marks = found(spark, f"{out}/marks", "upto date")
    mark = marks.agg(F.max("upto")).first()[0] if marks is not None else None
    events = spark.read.parquet(config["input"]).select(*SNAPSHOTS).where("ts is not null")
    if mark is not None:
        events = events.where(F.col("ts") >= F.lit(mark + timedelta(days=1)).cast("timestamp"))
    last = events.agg(F.max(F.to_date("ts"))).first()[0]  # still open
    closed = events.where(F.col("ts") < F.lit(last).cast("timestamp")) if last is not None else None
    upto, read = closed.agg(F.max(F.to_date("ts")), F.count("*")).first() if closed is not None else (None, 0)
    if upto is None:
        log.info("%s holds no closed day beyond %s: nothing to do", config["input"], mark)
        return {"mark": mark, "read": 0, "written": 0}
    fresh = closed
    if mark is not None:
        fresh = fresh.unionByName(spark.read.schema(closed.schema).parquet(f"{out}/walkers/upto={mark}"))
        before = spark.read.schema(TOTALS).parquet(f"{out}/totals/upto={mark}")
    else:
        before = spark.createDataFrame([], TOTALS)
    since = F.lit(str(mark or "0001-01-01")).cast("date")
    n = len(config["clusters"])
    edges = daily_flux(segments(fresh, config["clusters"]), n, config["basis"], config["target"])
    rows = with_totals(edges, before, since).repartition("day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/ledger")
    new = spark.read.schema(LEDGER).parquet(f"{out}/ledger").where(F.col("day") > since).where(F.col("day") <= F.lit(upto))
    totals = new.select("from_state", "to_state", F.col("w").alias("total")).unionByName(before)
    totals.groupBy("from_state", "to_state").agg(F.sum("total").alias("total")).write.mode("overwrite").parquet(f"{out}/totals/upto={upto}")
    newest = F.max_by(F.struct(*SNAPSHOTS), F.struct("ts", "event_id"))
    fresh.groupBy("user_id").agg(newest.alias("s")).select("s.*").write.mode("overwrite").parquet(f"{out}/walkers/upto={upto}")
    done = {"mark": upto, "read": read, "written": new.count()}
    spark.createDataFrame([(upto,)], "upto date").coalesce(1).write.mode("append").parquet(f"{out}/marks")
    log.info("read %d snapshots of %s after %s, wrote %d ledger rows, mark is now %s", done["read"], config["input"], mark, done["written"], upto)
    return done


def ledger(spark: SparkSession, config: dict) -> DataFrame:
    """The whole ledger as it stands."""
    return spark.read.schema(LEDGER).parquet(f"{config['output'].rstrip('/')}/ledger").select("day", "from_state", "to_state", "w", "total", "p")


if __name__ == "__main__":
    command_line("flux_ledger", run, __doc__.split("\n")[0])
