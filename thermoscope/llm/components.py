"""Connected components of a link table by alternating star contraction, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: the neighbours of each node move to the smallest of them.

    Minima are pre-aggregated, and the neighbours meet their minimum in a join
    that Spark can split when one node has a large share of all links.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = both if large else both.where("b < a")
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = pairs.join(least, "a")
    moved = met.where("b > a") if large else met
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every linked node; the component is its smallest node.

    ``edges`` holds pairs (a, b).  Each round is written to the shared folder, so
    the plan does not grow and a lost executor repeats one round at most.
    """
    state = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                          .distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        k += 1
        new = scratch.write(_stars(_stars(state, True), False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        r = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(r) == seen:
            break
        seen, state = tuple(r), new
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
