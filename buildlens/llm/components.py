"""Connected components of a large graph: smallest node of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is its component's smallest.

    Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger neighbours, then to its smaller ones. Each step is a
    grouped minimum (combined before the shuffle) joined back to the links, so
    no component is ever gathered in one task. Rounds grow with the logarithm of
    a component's width; each is checkpointed to the shared folder.
    """
    u, v = F.col("u"), F.col("v")
    now = checkpointed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(u != v).distinct()
    )
    seen = _state(now)
    while True:
        now = checkpointed(_to_smaller(_to_larger(now)))
        state = _state(now)
        if state == seen:
            break
        seen = state
    # now every link leads straight to the smallest node
    roots = now.select(v.alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(u.alias("node"), v.alias("root")).union(roots)


def _to_larger(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours link to the smallest node it knows."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _to_smaller(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours link to the smallest of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).filter(F.col("u") != F.col("v")).distinct()


def _state(links: DataFrame) -> tuple:
    mixed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed)).first())
