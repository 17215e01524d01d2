"""What the vector operators share: which vectors count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def proper(x: Column) -> Column:
    """Whether a vector is not null or zero and holds finite numbers only."""
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def numbers(df: DataFrame, vector: str) -> Column:
    """The vector as an array of floats, if that is what it is, or else of doubles."""
    return F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")


def usable(df: DataFrame, key: str, vector: str, *others: str) -> DataFrame:
    """(vec_id, x, others): rows with an id and a proper vector."""
    return df.select(F.col(key).cast("long").alias("vec_id"), numbers(df, vector).alias("x"), *others).filter(F.col("vec_id").isNotNull() & proper(F.col("x")))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)
