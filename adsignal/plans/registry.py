"""Where registered queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import ADS_SQL, TEXTS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, with_ads: bool = True, with_texts: bool = False):
    """Register a query under its function's name, with SQL over the tables (and the views of ads, or of ad texts)."""

    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[query.__name__] = query
        if sql:
            start = f"WITH {TEXTS_SQL}\n" if with_texts else f"WITH {ADS_SQL}\n" if with_ads else ""
            ORACLES[query.__name__] = start + sql
        return query

    return add
