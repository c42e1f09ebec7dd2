"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workboard.llm.common import stored


def _star(edges: DataFrame, large: bool, tag: str) -> DataFrame:
    """Link every neighbour of a node to the smallest node next to it (itself included).

    ``large``: only neighbours larger than the node move; else only the others. The
    minima are stored, so the join back is of two plain scans and a hub is split.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = stored(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{tag}-least")
    moved = near.filter("v > u") if large else near
    out = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``u, v``: each linked node other than the smallest of its component, and that smallest.

    ``edges`` has columns ``u`` and ``v`` (any order, no nulls). Ends when a round
    changes nothing; the number of rounds grows with the logarithm of the size.
    """
    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), tag)
    sign = None
    while True:
        now = stored(_star(_star(now, True, tag), False, tag), tag)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == sign:
            return now
        sign = new
