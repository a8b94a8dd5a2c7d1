"""Connected components of a graph given as edges, without a driver-side union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import kept


def _arrows(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) \
        .where("a <> b").distinct()


def _hooked(pairs: DataFrame) -> DataFrame:
    """Link every node's neighbours, and the node, to the smallest of them."""
    least = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    return pairs.join(least, "a").select(F.col("b").alias("x"), "a", "root")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of its component, for every node of an edge.

    Alternates large and small stars until the edges form stars. Minima are taken before the
    join, so that a node with many neighbours is one row there; every round is written to the
    shared folder.
    """
    now = kept(_arrows(edges.select("a", "b")), "links")
    mark = None
    while True:
        both = now.union(now.select("b", "a")).toDF("a", "b")
        large = _hooked(both).where("x > a").select(F.col("x").alias("a"), F.col("root").alias("b"))
        small = _hooked(_arrows(large))
        now = kept(_arrows(small.select(F.col("x").alias("a"), F.col("root").alias("b")).union(
            small.select("a", F.col("root").alias("b")))), "links")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast(
            "decimal(38,0)")).alias("h"), F.countDistinct("a").alias("nodes")).first()
        if state == mark:
            break
        mark = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct())
