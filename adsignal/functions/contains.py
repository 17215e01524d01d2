"""Joins of texts with the names that they contain, by n-grams instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(text: Column, size: int) -> Column:
    """The distinct substrings of a length; none of shorter texts."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(hays: DataFrame, hay: str, needles: DataFrame, needle: str, size: int = 3) -> DataFrame:
    """(hay, needle): which texts contain which names, whatever their case.  Both columns should hold distinct values.

    A name is looked up by the rarest of its n-grams alone; names shorter than ``size`` are n-grams themselves.  Null and
    empty names are contained in nothing.
    """
    asked = needles.select(F.col(needle).alias("needle"), F.lower(needle).alias("low")).filter("low <> ''")
    sizes = [r["n"] for r in asked.select(F.least(F.length("low"), F.lit(size)).alias("n")).distinct().collect()]  # at most ``size`` numbers
    text = F.lower(F.col(hay))
    held = hays.select(F.col(hay).alias("hay"), F.explode(F.concat(F.array().cast("array<string>"), *[_grams(text, n) for n in sizes])).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.array().cast("array<string>")
    for n in sizes:
        own = F.when(F.least(F.length("low"), F.lit(size)) == n, _grams(F.col("low"), n)).otherwise(own)
    looked_up = asked.withColumn("grams", own).select("needle", F.size("grams").alias("all"), F.explode("grams").alias("gram")).join(counts, "gram")
    rarest = looked_up.groupBy("needle", "all").agg(F.count("*").alias("found"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).filter("found = all").select("needle", "gram")
    return held.join(rarest, "gram").filter(F.contains(F.lower("hay"), F.lower("needle"))).select("hay", "needle")
