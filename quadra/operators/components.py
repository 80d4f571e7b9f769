"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join on the node, so that a node with very
many links is never gathered in one task: the minimum is an aggregate, and Spark splits skewed joins. A step
at least halves the depth of the trees, so the rounds grow with the logarithm of the longest path. Every
round is written to the shared folder and the round before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadra import runtime


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the smallest node among u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them; edges run from the larger node to the smaller."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(least.select("src", F.col("low").alias("dst"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """edges: src, dst (long, either direction, repeats and loops allowed). Returns node, component (its smallest node)
    for each node that has a link to another; no row for others."""
    clean = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now = runtime.save(clean, "edges")
    mark = _mark(now)
    while mark[0]:
        after = runtime.save(_small_star(_large_star(now)), "edges")
        runtime.drop(now)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
