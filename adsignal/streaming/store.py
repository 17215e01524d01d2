"""A store of ads that batches are merged into, and a cube that runs add their changes to.

Batches have numbers.  One that comes again, after a failure or by mistake, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracking
from ..sources.scratch import scratch

STORE = "ad_text string, image_url string, first_seen_date timestamp_ntz, last_seen_date timestamp_ntz, is_active boolean, batch long, advertiser_id string"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class AdStore:
    """Ads in one folder, partitioned by advertiser; a merge reads and rewrites the partitions of the batch's advertisers.

    Each row has the number of the batch that wrote its partition: a partition that has seen a batch, or a later one, is
    left alone by it, so that a merge that stopped half way is mended by its repetition.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], STORE)
        return self.spark.read.schema(STORE).parquet(self.path)

    def merge(self, batch: DataFrame, number: int, now: str, retire: bool = True) -> None:
        """``tracking.upsert`` of a batch (advertiser_id, ad_text, image_url), for the advertisers that it holds.

        ``now`` is the batch's own time: a repetition must have the same.
        """
        batch = tracking.keyed(batch.filter(F.col("advertiser_id").isNotNull())).select(*tracking.KEY)
        touched = batch.select("advertiser_id").distinct()
        existing = self.rows().join(F.broadcast(touched) if touched.limit(100_001).count() <= 100_000 else touched, "advertiser_id", "left_semi")
        done = existing.filter(F.col("batch") >= number).select("advertiser_id").distinct()
        batch, existing = batch.join(done, "advertiser_id", "left_anti"), existing.filter(F.col("batch") < number)
        version = tracking.upsert(existing, batch, now, retire=retire).withColumn("batch", F.lit(number).cast("long"))
        # Written aside first: what is read is then no more needed while its partitions are replaced.
        aside = scratch(self.spark, "merge")
        version.select(*self.rows().columns).write.parquet(aside)
        ready = self.spark.read.schema(STORE).parquet(aside)
        ready.repartition("advertiser_id", F.pmod(F.xxhash64("ad_text", "image_url"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("advertiser_id").parquet(self.path)


class Cube:
    """Counts by some columns, kept as one folder of changes a run; ``fold`` sums those of past runs into one."""

    def __init__(self, spark: SparkSession, path: str, dimensions: str, measures: list[str]) -> None:
        """``dimensions`` is a schema, as in 'day date, advertiser_id string'."""
        self.spark, self.path, self.measures = spark, path, measures
        self.by = [d.split()[0] for d in dimensions.split(", ")]
        self.schema = f"{dimensions}, {', '.join(f'{m} long' for m in measures)}"

    def _summed(self, rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*self.by).agg(*[F.sum(m).alias(m) for m in self.measures])
        return found.filter(" OR ".join(f"`{m}` <> 0" for m in self.measures))

    def add(self, changes: DataFrame, number: int) -> None:
        """A run's changes: rows of dimensions and measures, negative ones for what is taken back.  The cube isn't read."""
        self._summed(changes.select(*self.by, *[F.col(m).cast("long").alias(m) for m in self.measures])).write.mode("overwrite").parquet(f"{self.path}/run={number}")

    def _read(self, folder: str, least: int | None = None, most: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, run long").option("basePath", self.path).parquet(f"{self.path}/{folder}")
        rows = rows if least is None else rows.filter(F.col("run") > least)
        return (rows if most is None else rows.filter(F.col("run") <= most)).drop("run")

    def _folded(self) -> int | None:
        """The last run that is folded in."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/upto=*/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or []), default=None)

    def rows(self, most: int | None = None) -> DataFrame:
        base = self._folded()
        found = self._read("run=*", base, most)
        if base is not None:
            found = found.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/upto={base}"))
        return self._summed(found)

    def fold(self, most: int) -> None:
        """Sum all runs up to a number; later ones stay as they are.  Readers take the sum once it is whole."""
        if (-1 if (folded := self._folded()) is None else folded) < most:
            self.rows(most).write.mode("overwrite").parquet(f"{self.path}/upto={most}")


def changes_of(versions: DataFrame, by: dict[str, Column]) -> DataFrame:
    """What a run's ``tracking.upsert(before=True)`` means for a cube: by, ads (new ones) and active (less those that were before)."""
    ads, active = (F.col("change") == "new").cast("long"), F.col("is_active").cast("long") - F.col("was_active").cast("long")
    return versions.select(*[c.alias(n) for n, c in by.items()], ads.alias("ads"), active.alias("active")).filter("ads <> 0 OR active <> 0")
