"""Tables that lie sorted in buckets of a key, so that joins and merges on the key read them without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(rows: DataFrame, path: str, key: list[str], buckets: int) -> None:
    """rows at path, in so many buckets of the key, each sorted by it.  One shuffle, so that a bucket is one file."""
    name = f"bucketed_{uuid.uuid4().hex}"
    rows.repartition(buckets, *key).write.option("path", path).bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def read_bucketed(spark: SparkSession, path: str, schema: str, key: list[str], buckets: int) -> DataFrame:
    """What ``write_bucketed`` has left at path; the same key and number of buckets must be given."""
    name, by = f"bucketed_{uuid.uuid4().hex}", ", ".join(f"`{c}`" for c in key)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
