"""The text-free test tables as trajectories, segments and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.predicates import in_interval
from weftline.operators.trajectories import BLOCK, from_log, previous

#: Clusters are the event types in this order; the basis is state 5, the target 6.
CLUSTERS = ("click", "error", "purchase", "signup", "view")
BASIS, TARGET = (0.0, 5.0), (150.0, 1000.0)
A, B = (0.0, 5.0), (150.0, 1000.0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_trajs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_log(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.to_date("ts"), x="value", state="event_type")


def order_trajs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").withColumn("state", F.concat("o_orderstatus", "o_orderpriority"))
    return from_log(orders, "o_custkey", ["o_orderdate", "o_orderkey"], F.to_date("o_orderdate"), x="o_totalprice", state="state")


def turn_trajs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj"), F.col("turn").alias("idx"), F.col("role").alias("state"))


def in_a() -> Column:
    return in_interval(F.col("x"), A)


def in_b() -> Column:
    return in_interval(F.col("x"), B)


def cluster_of(label: str) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CLUSTERS]), F.col(label)).cast("long") - 1


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user as segments; an iteration's segments share its weight equally."""
    rows = previous(event_trajs(spark, sf_dir), ["x", "state"], ("traj",), BLOCK)
    rows = rows.withColumn("p0", F.col("_prev.x")).withColumn("from_label", F.col("_prev.state")).where("idx >= 1")
    n = rows.groupBy("idx").agg(F.count("*").alias("_n"))
    rows = rows.join(F.broadcast(n), "idx")
    return rows.select((F.col("traj") % 3).alias("file_idx"), F.col("idx").alias("n_iter"), F.col("traj").alias("seg_id"), F.col("traj").alias("parent_id"), "p0", F.col("x").alias("p1"), "from_label", F.col("state").alias("to_label"), cluster_of("from_label").alias("from_cluster"), cluster_of("state").alias("to_cluster"), (1.0 / F.col("_n")).alias("weight"))


def branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments with histories that merge and end: a fourth have another walker of their file as parent (which may
    have no segment there), those that end in the target are recycled and have none."""
    other = F.when((F.col("seg_id") + F.col("n_iter")) % 4 == 0, F.col("seg_id") + 3).otherwise(F.col("seg_id"))
    return segments(spark, sf_dir).withColumn("parent_id", F.when(F.col("p1") > TARGET[0], F.lit(-1).cast("long")).otherwise(other))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks over parts, a state each: from one line of an order to the next, among lines of at most three pieces."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    rows = read(spark, sf_dir, "lineitem").withColumn("from_state", F.lag("l_partkey").over(w)).where("from_state is not null and l_quantity <= 3")
    return rows.groupBy("from_state", F.col("l_partkey").alias("to_state")).agg(F.sum("l_quantity").cast("double").alias("w"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("bin"), F.col("embedding").cast("array<double>").alias("x"), F.lit(1.0).alias("weight"))
