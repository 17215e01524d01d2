"""Which ads are new, seen again or retired, and what changes in the store: every job returns a new version.

The key of an ad is (advertiser, text, image) with nulls as ''.  Joins use its 64-bit hash together with the full key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contains import containing
from ..functions.sizes import sent_if_small
from ..sources.scratch import scratch

KEY = ["advertiser_id", "ad_text", "image_url"]


def signature(*columns: str) -> Column:
    """The readable key: fields joined by '||'."""
    return F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def keyed(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    out = df
    for c in key:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def new_ads(scraped: DataFrame, existing: DataFrame, key: list[str] = KEY) -> DataFrame:
    return keyed(scraped, key).join(keyed(existing, key).select(*key), key, "left_anti")


def seen_ads(scraped: DataFrame, existing: DataFrame, key: list[str] = KEY) -> DataFrame:
    return keyed(scraped, key).join(keyed(existing, key).select(*key), key, "left_semi")


def retired_ads(existing: DataFrame, scraped: DataFrame, key: list[str] = KEY, owner: str = "advertiser_id") -> DataFrame:
    """Active ads of the advertisers in the snapshot that the snapshot lacks."""
    covered = scraped.select(F.coalesce(F.col(owner).cast("string"), F.lit("")).alias(owner)).distinct()
    return keyed(existing.filter("is_active"), key).join(covered, owner, "left_semi").join(keyed(scraped, key).select(*key), key, "left_anti")


def upsert(existing: DataFrame, scraped: DataFrame, now: str, key: list[str] = KEY, retire: bool = True, whole_keys: bool = False, before: bool = False) -> DataFrame:
    """One full outer join gives updates, inserts and retirements; ``change`` names what happened to each row, and, if
    asked for by ``before``, ``was_active`` says what it was before.

    Snapshot rows without an advertiser are skipped; equal snapshot rows are one.  Advertisers that the snapshot lacks
    are left alone.  ``whole_keys``: the store has no null in its key, which is then used as it is; a store in buckets of
    the key is merged without an exchange of its own.
    """
    snapshot = keyed(scraped.filter(F.col("advertiser_id").isNotNull()), key).select(*key, F.lit(True).alias("in_snapshot")).distinct()
    covered = snapshot.select("advertiser_id").distinct().withColumn("covered", F.lit(True))
    # Joined as Spark sees fit, unless that would shuffle a store that needs none.
    held, covered = (existing, sent_if_small(covered)) if whole_keys else (keyed(existing, key), covered)
    both = held.withColumn("in_store", F.lit(True)).join(snapshot, key, "full_outer").join(covered, "advertiser_id", "left")
    at, there, stored = F.lit(now).cast("timestamp_ntz"), F.coalesce("in_snapshot", F.lit(False)), F.coalesce("in_store", F.lit(False))
    gone = stored & ~there & F.coalesce("covered", F.lit(False)) & F.col("is_active") & F.lit(retire)
    change = F.when(there & stored, "updated").when(there, "new").when(gone, "retired").otherwise("kept")
    return both.select(*key, F.coalesce("first_seen_date", at).alias("first_seen_date"), F.when(there | gone, at).otherwise(F.col("last_seen_date")).alias("last_seen_date"), F.when(there, True).when(gone, False).otherwise(F.col("is_active")).alias("is_active"), change.alias("change"), *[(stored & F.coalesce("is_active", F.lit(False))).alias("was_active")] * before)


def run_record(versions: DataFrame, key: str = "advertiser_id") -> DataFrame:
    """Per advertiser what a run did."""
    return versions.groupBy(key).agg(*[F.count_if(F.col("change") == c).alias(f"ads_{c}") for c in ("new", "updated", "retired", "kept")])


def upsert_labels(old: DataFrame, new: DataFrame, key: str, fields: list[str], needs: list[str]) -> DataFrame:
    """Replace labels but for hand-edited rows; new rows without any of ``needs`` are left out."""
    usable = new.filter(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in needs]).isNotNull())
    o, n = old.alias("o"), usable.withColumn("is_new", F.lit(True)).alias("n")
    take = F.coalesce(F.col("n.is_new"), F.lit(False)) & ~F.coalesce(F.col("o.manually_edited"), F.lit(False))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.when(take, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields], F.coalesce("o.manually_edited", F.lit(False)).alias("manually_edited"))


def manual_edits(labels: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Apply (key, product_category?, product_name?) edits: nulls leave a field, rows that lack are inserted."""
    joined = labels.alias("o").join(edits.withColumn("edited", F.lit(True)).alias("e"), F.col(f"o.{key}") == F.col(f"e.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"e.{key}").alias(key), *[F.coalesce(f"e.{c}", f"o.{c}").alias(c) for c in ("product_category", "product_name")], F.coalesce("e.edited", "o.manually_edited", F.lit(False)).alias("manually_edited"))


def soft_delete(labels: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Mark ids as rejected; those without labels get a row of their own."""
    joined = labels.alias("o").join(ids.select(key).distinct().withColumn("gone", F.lit(True)).alias("d"), F.col(f"o.{key}") == F.col(f"d.{key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{key}", f"d.{key}").alias(key), "o.product_category", F.coalesce("d.gone", "o.rejected_wrong_region", F.lit(False)).alias("rejected_wrong_region"))


def contamination(rows: DataFrame, platforms: DataFrame) -> DataFrame:
    """Rows whose product name holds the name of a platform that another advertiser runs."""
    held = containing(rows.select("product_name").distinct(), "product_name", platforms.select("platform").distinct(), "platform")
    foreign = held.join(platforms.select(F.col("platform").alias("needle"), F.col("advertiser_id").alias("runs_it")), "needle").select(F.col("hay").alias("product_name"), "runs_it")
    return rows.join(foreign, (rows["product_name"] == foreign["product_name"]) & (rows["advertiser_id"] != foreign["runs_it"]), "left_semi")


def repair(rows: DataFrame, platforms: list[tuple[str, str]]) -> DataFrame:
    """The same rows with such product names set to null."""
    bad = F.lit(False)
    for platform, owner in platforms:
        bad = bad | (F.contains(F.lower("product_name"), F.lit(platform.lower())) & (F.col("advertiser_id") != owner))
    return rows.withColumn("product_name", F.when(~F.coalesce(bad, F.lit(False)), F.col("product_name")))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, which must tell rows of a key apart.

    Keys are sent as hashes with the order columns; whole rows stay where they are until the semi-join.
    """
    whole = [c for k in key for c in (F.col(k), F.isnull(k))]
    hashed = rows.withColumn("_h", F.xxhash64(*whole)).withColumn("_g", F.xxhash64(*whole, F.lit(1)))
    first = hashed.groupBy("_h", "_g").agg(F.min(F.struct(*order)).alias("_first"))
    return hashed.withColumn("_first", F.struct(*order)).join(first, ["_h", "_g", "_first"], "left_semi").drop("_h", "_g", "_first")


def sample_per_group(rows: DataFrame, group: str, n: int, first: Column, key: str) -> DataFrame:
    """The first n rows of each group, those for which ``first`` holds before others."""
    order = Window.partitionBy(group).orderBy(F.desc(first.cast("int")), key)
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def random_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The same n rows every time for a seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), key).limit(n)


def retention(rows: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    return rows.filter(F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz"))


def incremental_run(scraped: DataFrame, existing: DataFrame, label: Callable[[DataFrame], DataFrame], now: str, key: list[str] = KEY, batch: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One run as a job: (new version of the ads, labels of new ads, one record an advertiser).

    Only ads that the store lacks are labelled, at most ``batch`` of them if given (a feature of the run: the first by
    key; the others stay new and are labelled by a later run).  An advertiser of whom the store has nothing has a
    ``first`` run.
    """
    place = scratch(existing.sparkSession, "version")
    upsert(existing, scraped, now, key).write.parquet(place)  # read by all three results
    versions = existing.sparkSession.read.parquet(place)
    fresh = versions.filter("change = 'new'").select(*key)
    fresh = fresh.orderBy(*key).limit(batch) if batch else fresh
    had = keyed(existing, key).select("advertiser_id").distinct().withColumn("_had", F.lit(True))
    record = run_record(versions).join(had, "advertiser_id", "left").withColumn("kind", F.when(F.col("_had"), "update").otherwise("first")).drop("_had")
    return versions, label(fresh), record.withColumn("run_at", F.lit(now).cast("timestamp_ntz"))
