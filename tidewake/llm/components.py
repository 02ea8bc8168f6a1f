"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges (u, v) with u > v before and after."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    rest = large.join(down, F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(down.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none if others have edges down to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link to another; component is its smallest reachable node.

    Nulls and loops are ignored, repeated links count once. Each round is written to the shared
    folder; a hub's edges meet only in joins that adaptive execution can split and in minima that
    are combined before the shuffle. Raises RuntimeError if ``rounds`` aren't enough.
    """
    a_, b_ = F.col(a).cast("long"), F.col(b).cast("long")
    edges = written(links.filter(a_.isNotNull() & b_.isNotNull() & (a_ != b_)).select(F.greatest(a_, b_).alias("u"), F.least(a_, b_).alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _is_stars(edges):
            break
        edges = written(_stars(edges), "edges")
    else:
        raise RuntimeError(f"components aren't stars after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
