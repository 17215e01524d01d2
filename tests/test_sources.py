"""Bucketed stores, tables in ranges and with staging, broken lines."""

import pytest
from pyspark.sql import functions as F

from adsignal.operators import gallery, tracking
from adsignal.sources import bucketed, readers


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_joins_of_a_bucketed_store_exchange_nothing(spark, tmp_path, no_broadcast):
    ads = spark.range(500).select(F.col("id").alias("ad_id"), F.lit("a").alias("advertiser_id"), F.lit(True).alias("is_active"))
    labels = spark.range(0, 500, 2).select(F.col("id").alias("ad_id"), F.lit("x").alias("product_category"), F.lit(False).alias("rejected_wrong_region"))
    held = []
    for name, rows in (("ads", ads), ("labels", labels)):
        bucketed.write_bucketed(rows, str(tmp_path / name), ["ad_id"], 8)
        held.append(bucketed.read_bucketed(spark, str(tmp_path / name), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), ["ad_id"], 8))
    joined = gallery.enriched(*held)
    plan = final_plan(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 500


def test_a_merge_exchanges_the_snapshot_alone(spark, tmp_path, no_broadcast):
    kind = "advertiser_id string, ad_text string, image_url string, first_seen_date timestamp_ntz, last_seen_date timestamp_ntz, is_active boolean"
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(300).select(F.concat(F.lit("a"), F.col("id") % 3).alias("advertiser_id"), F.col("id").cast("string").alias("ad_text"), F.concat(F.lit("i"), F.col("id") % 2).alias("image_url"), at.alias("first_seen_date"), at.alias("last_seen_date"), F.lit(True).alias("is_active"))
    bucketed.write_bucketed(rows, str(tmp_path / "store"), tracking.KEY, 8)
    store = bucketed.read_bucketed(spark, str(tmp_path / "store"), kind, tracking.KEY, 8)
    snapshot = spark.range(100, 400).select(F.concat(F.lit("a"), F.col("id") % 3).alias("advertiser_id"), F.col("id").cast("string").alias("ad_text"), F.concat(F.lit("i"), F.col("id") % 2).alias("image_url"))
    version = tracking.upsert(store, snapshot, "2024-02-01", whole_keys=True)
    lines = final_plan(version).splitlines()
    above = lines[: next(i for i, line in enumerate(lines) if "FileScan" in line)]
    assert any("SortMergeJoin [advertiser_id" in line for line in above) and not any("Exchange" in line for line in above)
    plain = tracking.upsert(rows, snapshot, "2024-02-01")
    assert sorted(map(str, version.collect())) == sorted(map(str, plain.collect()))


def test_tables_are_read_in_ranges_and_loaded_once(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1000).select(F.col("id").alias("creative_id"), F.concat(F.lit("c"), "id").alias("name"))
    readers.write_table(rows.filter("creative_id < 100"), url, "creatives")
    assert readers.load_table(rows.filter("creative_id < 500").unionByName(rows.filter("creative_id < 500")), url, "creatives", "creative_id", "one") == 400
    assert readers.load_table(rows.filter("creative_id < 500"), url, "creatives", "creative_id", "one") == 0
    nulls = rows.unionByName(spark.createDataFrame([(None, "no key")], "creative_id long, name string"))
    assert readers.load_table(nulls.withColumn("more", F.lit(1)), url, "creatives", "creative_id", "two") == 500
    held = readers.table(spark, url, "creatives", "creative_id", 5)
    assert held.rdd.getNumPartitions() == 5 and sorted(map(tuple, held.collect())) == sorted(map(tuple, rows.collect()))
    # A load that failed between its two steps has left staging behind.
    rows.limit(10).write.format("jdbc").options(url=url, dbtable="creatives_three").save()
    assert readers.load_table(rows, url, "creatives", "creative_id", "three") == 0
    with pytest.raises(Exception, match="(?i)creatives_three"):
        readers.table(spark, url, "creatives_three").count()


def test_broken_lines_are_kept_and_counted(spark, tmp_path):
    head = ",".join(readers.MANUAL_NAMES)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text(f"{head}\nAcme,http://i/x.png,Image,QA,1,1/2/2024,1/3/2024,https://x/advertiser/AR1/creative/CR1\nbroken,line\nAcme,,,,,,,\n")
    (tmp_path / "in" / "two.csv").write_text(f"{head}\n" + "a," * 30 + "\n")
    rows, broken, counts = readers.quarantined(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted((r.file, r.line) for r in broken.collect()) == [("one.csv", "broken,line"), ("two.csv", "a," * 30)]
    assert rows.count() == 2 and counts == {"lines": 4, "broken": 2, "without_link": 1}
    assert readers.converted(rows).count() == 1
