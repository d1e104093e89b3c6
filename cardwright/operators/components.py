"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwright.session import staged, unstage


def _roots(hooks: DataFrame) -> DataFrame:
    """node, parent with parent < node: each node's last ancestor, by doubling the step."""
    now = staged(hooks, "hooks")
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        after = staged(now.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "hooks")
        more = not after.where("moved").isEmpty()
        unstage(now)
        now = after
        if not more:
            return now


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of the edges' first two columns, which are ids of one type.

    Each node hooks to its least neighbour, chains are shortened by pointer doubling, and the edges between what are now
    the same nodes are dropped; with each round at least half of the remaining nodes go. Hot nodes only meet in sums
    (min), which are made in part before the shuffle, and in joins that Spark can split. Null ends are no edges.
    """
    a, b = edges.columns[:2]
    left = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    labels, first = None, left
    while True:
        both = left.where("a <> b").select("a", "b").union(left.where("a <> b").select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).where("parent < node")
        hooks = _roots(least)
        if hooks.isEmpty():
            break
        up = hooks.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        if labels is None:
            labels = staged(hooks.select("node", F.col("parent").alias("component")), "labels")
        else:
            old = labels
            moved = old.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            fresh = hooks.select("node", F.col("parent").alias("component")).join(old.select("node"), "node", "left_anti")
            labels = staged(moved.union(fresh), "labels")
        ends = left.join(up.select(F.col("component").alias("a"), F.col("root").alias("ra")), "a", "left").join(up.select(F.col("component").alias("b"), F.col("root").alias("rb")), "b", "left")
        left = staged(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct(), "edges")
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
