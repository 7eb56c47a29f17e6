"""Connected components of an edge list, in DataFrame operations only.

Each round is one large-star and one small-star step. A step joins every edge with the smallest neighbour
of its end, so no node's neighbour list is ever gathered: hubs are ordinary skewed join keys, which the
adaptive optimiser splits. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").select(F.col("m").alias("a"), "b")
    return kept.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a``, ``b``); the root is the smallest node.

    Nulls and loops are no edges. An edge list without edges gives no rows.
    """
    now = checkpointed(edges.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        was, mark = mark, tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == was or not mark[0]:
            roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        now = checkpointed(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
