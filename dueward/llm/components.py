"""Connected components of an edge table by alternating large-star and small-star (Kiveris et al., 2014).

Every round is two aggregates and two joins on an edge endpoint, so a hub is a skewed join key that adaptive
execution splits, never a list in one row. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dueward.llm.common import stored

def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.selectExpr("v AS u", "u AS v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or itself)."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, move to the smallest of them."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").selectExpr("v AS u", "m AS v")
    return moved.unionByName(least.selectExpr("u", "m AS v")).where("u <> v")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(u, v)`` edges of long ids to ``(node, root)``: every node that has an edge, and its component's smallest id.

    Self-loops, repeated edges and an empty table are fine; edges with a null end are ignored.
    """
    current = stored(edges.select("u", "v").where("u <> v").distinct())
    signature = None
    for _ in range(rounds):
        found = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == signature or found[0] == 0:
            break
        signature = found
        current = stored(_small_star(_large_star(current).distinct()).distinct())
    else:
        raise RuntimeError("the components did not settle")
    roots = current.selectExpr("v AS node").distinct().selectExpr("node", "node AS root")
    return current.selectExpr("u AS node", "v AS root").unionByName(roots)
