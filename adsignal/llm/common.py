"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.adsignal.scratch", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="adsignal-")
        spark.conf.set("spark.adsignal.scratch", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, tag: str, gathered: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    gathered: for small rows out of long tasks.  They pass through a shuffle into files of a reasonable size, so that no
    task writes a small file of its own while Python works beside it.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if gathered else df
    path = f"{shared_dir(spark)}/adsignal-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number of folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """How many partitions hold so many rows: at least two for each core there is."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_task))


def met(left: DataFrame, right: DataFrame, on: list[str], row: str, how: str = "inner", bound: int = 1_000_000, salts: int = 16) -> DataFrame:
    """Equi-join with a right side of one row a key: sent to all tasks up to a counted bound of rows, else shuffled.

    In a shuffle the left rows of one key are dealt over so many salts by a hash of their row number, and each right
    row goes to all salts, so that no task gets all rows of a frequent key.
    """
    if right.count() <= bound:
        return left.join(F.broadcast(right), on, how)
    dealt = left.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return dealt.join(copies, [*on, "salt"], how).drop("salt")
