"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import stored


def _around(links: DataFrame, floor: bool) -> DataFrame:
    """Each link (u, v) with the least of u's neighbours and u itself; with ``floor``, of those below u."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return links.join(least, "u") if not floor else links.filter("v < u").join(least, "u")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its smallest node.

    Alternating large-star and small-star steps: links are rewired towards smaller nodes until
    every node points at its component's smallest. Each round is one written table; no link
    leaves the executors and no group is gathered in a task.
    """
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _around(both, False).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = _around(large, True).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        now = stored(small, "links")
        # The links' number and sums stand still when, and only when, no step changes them.
        state = now.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components weren't settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
