"""Connected components by alternating large and small stars.

Every round is two joins on aggregated minima; no neighbour list is ever gathered, so a hub of any degree is only a
join key that adaptive execution may split.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component the smallest node that it reaches."""
    held = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    held = stored(held, "edges")
    before = _state(held)
    while before[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        held = stored(small, "edges")
        after = _state(held)
        if after == before:
            break
        before = after
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
