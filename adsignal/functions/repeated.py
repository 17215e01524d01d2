"""Work that depends on few columns, done once for each of their combinations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .sizes import sent_if_small

ID = "id_"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """rows, written where all executors see them and read from there: worked out once, whatever is asked of them."""
    path = scratch(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def once_each(rows: DataFrame, on: list[str], work: Callable[[DataFrame], DataFrame], how: str = "left") -> DataFrame:
    """rows, joined with what ``work`` gives for each distinct combination of ``on``, nulls included.

    ``work`` takes these with a number (``ID``) each, and returns rows with that number and the new columns.
    """
    distinct = written(rows.select(*on).distinct().withColumn(ID, F.monotonically_increasing_id()), "distinct")
    found = written(distinct.join(work(distinct), ID).drop(ID).withColumnsRenamed({c: f"{c}{ID}" for c in on}), "found")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}{ID}")) for c in on])
    return rows.join(sent_if_small(found), same, how).drop(*[f"{c}{ID}" for c in on])
