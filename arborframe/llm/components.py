"""Connected components by alternating star contractions, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction.  ``edges``: ``a < b``.

    Large star: every node links its larger neighbours to its smallest
    neighbour (itself included).  Small star: every node links itself and its
    smaller neighbours to the smallest of them.
    """
    if large:
        both = edges.union(edges.select("b", "a"))
    else:
        both = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")).select(F.col("a").alias("node"), "least")
    joined = both.join(least, both["a"] == least["node"])
    if large:
        moved = joined.where("b > a").select(F.col("least").alias("a"), "b")
    else:
        moved = joined.select(F.col("least").alias("a"), "b").union(least.select(F.col("least").alias("a"), F.col("node").alias("b")))
    return moved.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the smallest node reachable.

    Each round is written to the shared folder, so the plan does not grow and
    a lost executor costs one round at most.  The rounds grow with the
    logarithm of the size of a component.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges, before = saved(ordered, "components"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = saved(_stars(_stars(edges, large=True), large=False), "components")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
