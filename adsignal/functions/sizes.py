"""Which side of a join may be sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sent_if_small(rows: DataFrame, most: int = 20_000) -> DataFrame:
    """rows, to be broadcast if a count of at most ``most`` + 1 of them finds no more; else joined as Spark sees fit."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
