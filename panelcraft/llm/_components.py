"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcraft.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour on one side of ``a`` to the smallest node around ``a``."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    linked = around.join(least, "a")
    if large:
        linked = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node of ``edges`` (``a, b`` longs).

    Each round is written to the checkpoint folder; the rounds grow with the
    logarithm of the longest path. A node's neighbours meet in aggregations with
    map-side combine and in joins that adaptive execution can split. Nodes are
    not null; self-links are ignored; no edges give no rows.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        edges = materialise(_star(_star(edges, large=True), large=False), "edges")
        now = tuple(edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = now
