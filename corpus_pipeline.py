"""The corpus pipeline: reject poor documents, keep one of each near-duplicate group, sanitise, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.

Defined cases: null and empty texts are kept by every stage, as empty ones; every row is a document of its own, also
where ids repeat or are missing: equal rows are copies, of which one stays; of a near-duplicate group the row with the
smallest id stays, one without an id only where no other has one; extra columns are dropped; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adsignal.llm import jaccard_join, packing, pii, quality
from adsignal.llm.common import load, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 80 of 100 five-word shingles, directly or by links."""
    rows = stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    found = jaccard_join.similar_documents(rows, k=5, percent=80, key="row")
    found = stored(found.select(F.col("doc_id").alias("row"), "component_id"), "groups")
    several = found.filter("row <> component_id").select("component_id").distinct()
    grouped = found.join(several, "component_id").join(rows.select("row", "doc_id"), "row")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row"))["row"].alias("first"))
    gone = stored(grouped.join(first, "component_id").filter("row <> first").select("row"), "gone")
    gone = F.broadcast(gone) if gone.count() <= 1_000_000 else gone  # 8 MB; beyond that a shuffled join
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised and disclosing terms removed; n_chars follows."""
    return pii.sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("near duplicates", dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: SQL has no compression, tokenizers or local search: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"stage{n}")
    return docs
