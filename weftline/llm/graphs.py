"""Connected components of an edge table, by contraction; every step is a join or a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b); comp is the smallest node reachable. Nodes: any orderable type.

    Each round points every node at its smallest neighbour, follows those pointers to their roots and replaces the
    edges by edges between roots, so the number of nodes with edges at least halves. Loops and repeated edges are
    allowed; no edges give an empty table.
    """
    edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while n := edges.count():
        up = keep(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp")), "parents", n)
        while True:  # pointer jumping; parents are smaller than their nodes, so this ends
            over = up.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            jumped = keep(up.join(over, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"), F.col("top").isNotNull().alias("moved")), "jumped", n)
            up = jumped.select("node", "comp")
            if jumped.where("moved").isEmpty():
                break
        to = lambda c: up.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_top"))
        roots = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_top", "a").alias("x"), F.coalesce("b_top", "b").alias("y"))
        if labels is None:
            nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
            labels, m = nodes.join(up, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), 2 * n
        else:
            labels = labels.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        labels = keep(labels, "labels", m)
        edges = keep(roots.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", n)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, comp) after more edges (a, b); nodes without a label are components of their own."""
    to = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_top"))
    between = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_top", "a").alias("a"), F.coalesce("b_top", "b").alias("b"))
    tops = components(between)
    old = labels.join(tops.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = tops.join(labels, "node", "left_anti")
    return keep(old.union(new), "merged")
