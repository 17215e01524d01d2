"""Product knowledge: lookup by name, upserts, documents for an index, vector search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.contains import containing


def lookup(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(query, product_name, how): equal name whatever its case, else the shortest name that contains the query.

    Only queries without an equal name go on to the containment join, which goes by n-grams.
    """
    asked = queries.select("query").filter("query <> ''").distinct()
    names = known.select("product_name").distinct()
    equal = asked.join(names, F.lower("query") == F.lower("product_name")).groupBy("query").agg(F.min("product_name").alias("product_name")).withColumn("how", F.lit("exact"))
    rest = asked.join(equal, "query", "left_anti")
    near = containing(names, "product_name", rest, "query").groupBy(F.col("needle").alias("query")).agg(F.min(F.struct(F.length("hay").alias("n"), "hay"))["hay"].alias("product_name"))
    return equal.unionByName(near.withColumn("how", F.lit("contains")))


def stats(known: DataFrame) -> DataFrame:
    """How many items there are, by what they are flagged as, and their mean confidence."""
    flags = ("is_restaurant", "is_subscription", "is_unknown_category")
    return known.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c.removeprefix("is_")) for c in flags], F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def pending_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the queue of items that wait to be indexed (JSON files, one item a line); broken lines are left out."""
    queue = spark.read.schema("product_name string, product_type string, category string, confidence double, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return documents(queue.filter("_broken IS NULL AND coalesce(product_name, '') <> ''"))


def index(stored: DataFrame, found: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index with new documents embedded (id, document, metadata -> and embedding); of one id the new one counts.

    Of several new documents of one id the last by text counts, so that a queue may be read twice.
    """
    latest = found.groupBy("id").agg(F.max(F.struct("document", "metadata")).alias("x")).select("id", "x.*")
    kept = stored.join(latest.select("id"), "id", "left_anti")
    return kept.select("id", "document", "metadata", "embedding").unionByName(embed(latest).select("id", "document", "metadata", "embedding"))


def upsert(known: DataFrame, found: DataFrame, key: str = "product_name", least: float = 0.7) -> DataFrame:
    """Sure enough findings replace what is known; of several for one name the surest counts."""
    both = known.withColumn("_new", F.lit(0)).unionByName(found.filter(F.col("confidence") >= least).withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc("confidence"), *[c for c in known.columns if c != key])
    return both.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r", "_new")


def documents(items: DataFrame) -> DataFrame:
    """(id, document, metadata as JSON) of knowledge items, with defaults."""
    text = F.format_string("%s is a %s product in the category %s.", F.col("product_name"), F.coalesce("product_type", F.lit("unknown")), F.coalesce("category", F.lit("Unknown")))
    meta = F.to_json(F.struct(F.coalesce("product_type", F.lit("unknown")).alias("product_type"), F.coalesce("category", F.lit("Unknown")).alias("category")))
    return items.select(F.col("product_name").alias("id"), text.alias("document"), meta.alias("metadata"))


def gate(labels: DataFrame, known: DataFrame, least: float = 0.75, trusted: float = 0.5) -> DataFrame:
    """Unsure product types take the verdict and confidence of the knowledge base where that is trusted; ``source`` records it."""
    k = known.select(F.lower("product_name").alias("_name"), F.col("product_type").alias("_type"), F.col("confidence").alias("_sure"))
    joined = labels.join(k, F.lower("brand") == F.col("_name"), "left")
    use = (joined["confidence"] < least) & F.coalesce(F.col("_sure") > trusted, F.lit(False))
    joined = joined.withColumn("_use", use)
    use = F.col("_use")
    return joined.withColumn("product_type", F.when(use, F.col("_type")).otherwise(F.col("product_type"))).withColumn("confidence", F.when(use, F.col("_sure")).otherwise(F.col("confidence"))).withColumn("source", F.when(use, "knowledge").otherwise("rules")).drop("_name", "_type", "_sure", "_use")


def search(queries: DataFrame, stored: DataFrame, k: int = 3, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", query_block: int = 4096, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest stored vectors of each query, ties (of nine digits) to smaller ids.

    Queries and stored vectors are dealt into blocks, and every two blocks meet in a task, which returns k rows a query;
    nothing passes through the driver.  Vectors that are null, zero or hold null or non-finite numbers take no part, nor
    do those of another length than the query's.  ``carried`` joins a result with documents.
    """

    def usable(rows: DataFrame) -> DataFrame:
        x = F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
        finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
        return rows.select(F.col(key).cast("long").alias("id"), x.alias("v")).filter("id IS NOT NULL AND size(v) > 0").filter(finite & F.exists(x, lambda c: c != 0))

    n_query_blocks, n_blocks = max(1, -(-queries.count() // query_block)), max(1, -(-stored.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = usable(queries).withColumn("dim", F.size("v")).withColumn("i", F.pmod(F.xxhash64("id"), F.lit(n_query_blocks)).cast("int")).withColumn("j", every(n_blocks))
    held = usable(stored).withColumn("dim", F.size("v")).withColumn("j", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("i", every(n_query_blocks))

    def matrix(table: pa.Table) -> np.ndarray:
        return table["v"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(table), -1)

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        ids, others, distances = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
        if len(one) and len(two):
            q, x, names, own = matrix(one), matrix(two), one["id"].to_numpy(), two["id"].to_numpy()
            x, squares = (x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x), (x**2).sum(1)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                if metric == "cosine":
                    far = 1 - (part / np.linalg.norm(part, axis=1, keepdims=True)) @ x.T
                else:
                    far = np.sqrt(np.maximum((part**2).sum(1)[:, None] + squares[None] - 2 * part @ x.T, 0))
                far = np.round(far, 9)
                # All up to the k-th distance, ties included; these alone are sorted.
                least = np.partition(far, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                rows, columns = np.nonzero(far <= least[:, None])
                order = np.lexsort((own[columns], far[rows, columns], rows))
                rows, columns = rows[order], columns[order]
                best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                ids.append(names[at : at + 256][rows[best]])
                others.append(own[columns[best]])
                distances.append(far[rows[best], columns[best]])
        return pa.table({"query_id": np.concatenate(ids), "vec_id": np.concatenate(others), "distance": np.concatenate(distances)})

    found = asked.groupBy("dim", "i", "j").cogroup(held.groupBy("dim", "i", "j")).applyInArrow(run, "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def carried(found: DataFrame, items: DataFrame, key: str = "vec_id") -> DataFrame:
    """Search results with the stored items' other columns (document, metadata)."""
    return found.join(items.withColumnRenamed(key, "vec_id"), "vec_id")
