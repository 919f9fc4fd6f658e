"""Connected components of an undirected graph as Spark joins and aggregations (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges has (u, v) with u > v. The minimum of each node's neighbours is an aggregation with
    map-side combine; it is joined back by node, where a node with very many neighbours is a skewed join."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    near = both.join(least, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root), root being the smallest node reachable; a node that is its own root has no row.
    Self links and nulls are ignored. Each round is written to the shared folder, so a lost executor costs one round."""
    at = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        half = written(_star(at, True), "edges")
        new = written(_star(half, False), "edges")
        discard(half)
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(at)
        at = new
        if now == mark:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
