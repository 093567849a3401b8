"""Connected components of a link table, by alternating large and small stars.

Each round a node's links are redirected to its smallest neighbour; what is left in the end are stars around the
smallest node of each component. Rounds grow with the logarithm of the number of nodes. Minima are combined before
the shuffle, a node with very many links meets one row in the join, and nothing is gathered in one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import discard, saved


def _state(edges: DataFrame) -> tuple:
    """A digest of the link table that doesn't depend on the order of its rows."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node of its component."""
    cur = saved(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "links")
    before = _state(cur)
    while before[0]:
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: larger neighbours of a node go to the smallest of all its neighbours and itself.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, cur = cur, saved(small.where("a <> b").distinct(), "links")
        discard(old)
        after = _state(cur)
        if after == before:
            break
        before = after
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
