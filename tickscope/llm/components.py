"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickscope.llm.common import stored

SALTS = 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: each node that has an edge, with the smallest node reachable from it.

    Each round hangs every larger neighbour of a node on the node's least neighbour (large star), then
    every smaller one and the node itself (small star); the number of edges never grows, and the
    rounds end when all edges lead to roots, after O(log² n) rounds at most and a few in practice. Minima are
    combined map-side and go back to the edges of a node under ``SALTS`` keys, so a node with very many edges
    is spread over as many tasks. Each round is a written table: lost executors recompute one round only.
    """
    edges = stored(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, spread_by: str) -> DataFrame:
    """``edges`` (center, ...) joined with the least neighbour ``m`` of their centers."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).join(salted, ["center", "salt"])


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node: its larger neighbours, each with the least of the neighbours and the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "center")
    larger = edges.select(F.col("v").alias("center"), F.col("u").alias("far"))
    return _with_least(larger, least, "far").select(F.col("far").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node: its smaller neighbours and itself on the least of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "center")
    smaller = _with_least(edges.withColumnRenamed("u", "center"), least, "v").where("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("center").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(own).distinct()
