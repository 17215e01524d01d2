"""Row functions, labels, tracking and sources on small fixtures."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from adsignal.functions import text as tx
from adsignal.functions.contains import containing
from adsignal.operators import insights, knowledge, labels, reports, tracking
from adsignal.sources import readers


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "kind", "details", "condition"),
    [
        ("50% off your first order", "percentage_discount", "50", "first order"),
        ("خصم 30% على كل شيء", "percentage_discount", "30", ""),
        ("QAR 20 off orders above QAR 50", "fixed_discount", "20", "min order"),
        ("Free delivery today", "free_delivery", "", ""),
        ("Buy 1 Get 1 Free", "bogo", "", ""),
        ("buy 3 get 2", "bogo", "", ""),
        ("today b1g1 only", "bogo", "", ""),
        ("No delivery fee, for 3 days only", "free_delivery", "", "limited time"),
        ("تخفيض 20 ريال عملاء جدد", "fixed_discount", "20", "first order"),
        ("عرض خاص", "special_offer", "", ""),
        ("40% off, limited time, first order", "percentage_discount", "40", "limited time"),
        ("Taste happiness every day", "none", "", ""),
        ("Try our new menu item", "new_product", "", ""),
        (None, "none", "", ""),
    ],
)
def test_offers(spark, text, kind, details, condition):
    first = one(spark, text, labels.offers)[0]
    assert first["type"] == kind and details in first["details"] and condition in first["conditions"]


@pytest.mark.parametrize(("text", "region", "ok"), [("限时优惠 快来买", "INVALID", False), ("Order in Dubai, call +971", "AE", False), ("Delivery in Doha", "QA", True), ("", "QA", True), (None, "QA", True)])
def test_region(spark, text, region, ok):
    found = one(spark, text, labels.region)
    assert (found["detected"], found["is_valid"]) == (region, ok)


@pytest.mark.parametrize(("text", "brand", "category"), [("fresh tacos and burrito", None, "Mexican"), ("acai smoothie bowl", None, "Healthy"), ("hungry?", "Chipotle", "Mexican"), ("شاورما", None, "Shawarma & Street Food"), ("burger and pizza", None, "Mixed"), ("shoes", None, None)])
def test_food(spark, text, brand, category):
    df = spark.createDataFrame([(text, brand)], "t string, b string")
    assert df.select(labels.food(F.col("t"), F.col("b")).alias("f")).first()["f"]["category"] == category


def test_chain_leaves_rejected_ads_unlabelled(spark):
    ads = spark.createDataFrame([(1, "Free delivery in Doha pizza"), (2, "Dubai mall 20% off"), (3, None)], "ad_id long, ad_text string").withColumn("advertiser_id", F.lit("a"))
    rows = {r.ad_id: r for r in labels.enrich(ads).collect()}
    assert rows[1].offer_type == "free_delivery" and rows[2].rejected_wrong_region and rows[2].offer_type is None and rows[3].offer_type == "none"


def test_brands(spark):
    catalog = spark.createDataFrame([("McDonald's", "McDonald's", "brand", 1), ("McDonald's", "mcdonald", "brand", 1), ("Lulu", "lulu", "brand", 1), ("NutriBullet", "nutri bullet", "brand", 1), ("Talabat", "talabat", "platform", 0)], labels.NO_CATALOG)
    ads = spark.createDataFrame([(1, "McDonald's on talabat"), (2, "absolutely great"), (3, "the new nutri bullet, nutri bullet"), (4, "x_lulu_y"), (5, "a macdonalds meal"), (6, None), (7, "MCDONALD'S")], "ad_id long, ad_text string")
    found = {(r.ad_id, r.brand): (r.source, r.confidence) for r in labels.brand_scan(ads, catalog, "ad_id").collect()}
    assert found[(1, "McDonald's")] == ("catalog", 0.97) and found[(5, "McDonald's")][0] == "catalog_fuzzy" and 0.75 <= found[(5, "McDonald's")][1] < 0.85
    assert set(found) == {(1, "McDonald's"), (3, "NutriBullet"), (4, "Lulu"), (5, "McDonald's"), (7, "McDonald's")} and found[(4, "Lulu")][0] == "catalog_substring"
    assert labels.brand_scan(ads, catalog.limit(0), "ad_id").count() == 0


def test_unknown_brands_and_hints(spark):
    asked = lambda text: [(m["name"], m["source"]) for m in one(spark, text, lambda c: labels.unknown_brands(c, None, ["Zara"], ["Talabat"]))]
    assert asked("Order online from DE'LONGHI HOME ONLINE WITH ONE HOUR DELIVERY")[0] == ("De'Longhi Home", "said")
    assert asked("https://talabat.example/qatar/the-big-grill-2 Meal Deals at Zara") == [("Zara", "said"), ("The Big Grill 2", "link")]
    assert asked("we love Blue Palm Kitchen. Talabat Market") == [("Blue Palm Kitchen", "phrase")] and asked(None) == []
    match = F.array(F.struct(F.lit("A").alias("name"), F.lit(0.9).alias("confidence")))
    held = spark.range(1).select(labels.with_hints(match, F.array(F.lit("a"))).alias("x"), labels.with_hints(match, F.array(F.lit("B")), ["b"]).alias("y")).first()
    assert held.x.matches[0].confidence == 0.99 and not held.x.inferred and held.y.inferred and held.y.conflict and held.y.matches[1].confidence == 0.82


def test_subscription(spark):
    catalog = spark.createDataFrame([("a", "Pro", ["pro"], ["talabat"], True), ("b", "Off", ["off"], ["x"], False)], "advertiser_id string, name string, keywords array<string>, platform_terms array<string>, enabled boolean")
    ads = spark.createDataFrame([("a", "talabat pro"), ("a", "talabat"), ("b", "x off"), ("c", "a membership")], "advertiser_id string, ad_text string")
    assert sorted((r.advertiser_id, r.subscription_confidence) for r in labels.subscription(ads, catalog).collect()) == [("a", 0.2), ("a", 0.95), ("b", 0.0), ("c", 0.15)]


def test_links_dates_and_sizes(spark):
    link = "https://x.example/advertiser/AR12/creative/CR9?region=AE"
    assert one(spark, link, lambda c: tx.link_ids(c)[0]) == "AR12" and one(spark, link, lambda c: tx.link_ids(c)[1]) == "CR9"
    assert one(spark, link, lambda c: tx.url_parameter(c, "region", "QA")) == "AE" and one(spark, "http://x", lambda c: tx.url_parameter(c, "region", "QA")) == "QA"
    assert one(spark, '<img src="a.png">', tx.image_source) == "a.png" and one(spark, None, tx.image_source) == ""
    assert one(spark, 'width="300" height="250"', tx.size_bucket) == "Medium Rectangle" and one(spark, 'width="800" height="90"', tx.size_bucket) == "Banner"
    assert str(one(spark, "Jan 2, 2024 - Feb 3, 2024", lambda c: tx.date_range(c)[1])) == "2024-02-03"
    assert one(spark, "a-big-shop_2", tx.slug_title) == "A Big Shop 2" and one(spark, "123", tx.slug_title) is None
    assert one(spark, 'width="300" height="400"', tx.size_bucket) == "Vertical"
    assert one(spark, "http://i.ytimg.com/vi/abcdefghijk/0.jpg", tx.youtube_id) == "abcdefghijk"
    assert one(spark, "1. Visible Text: SALE\n2. Brand: **Acme**", lambda c: tx.sections(c, ["visible_text", "brand"]))["visible_text"] == "SALE"
    assert one(spark, '```json\n{"a": 1}\n```', lambda c: tx.json_in_reply(c, "a int"))["a"] == 1


def test_json_layouts(spark):
    reply = {"1": [{"1": "AR1", "2": "CR1", "3": {"3": {"2": "<img>"}}, "4": {"1": "10"}, "6": {"1": "20"}, "7": [{"2": "QA"}], "12": {"2": [{"1": "Acme"}]}}]}
    row = readers.response_ads(spark.createDataFrame([(json.dumps(reply),)], "value string")).first()
    assert (row.advertiser_name, row.first_shown, row.last_shown, row.regions) == ("Acme", 10, 20, "QA")
    other = {"1": [{"1": "AR1", "2": "CR1", "4": 2, "6": {"1": "1"}, "7": {"1": "2"}, "12": "Acme"}, {"1": "AR2"}]}
    assert readers.extension_ads(spark.createDataFrame([(json.dumps(other),)], "value string")).count() == 1


def test_csv_and_conversion(spark, tmp_path):
    head = "Advertiser,Creative,Format,Region Filter,Campaign Duration,First Seen,Last Seen,GATC Link"
    (tmp_path / "m.csv").write_text(f"{head}\nAcme,http://i/x.png,Image,QA,1,1/2/2024,1/3/2024,https://x/advertiser/AR1/creative/CR1\nAcme,,,,,,,nothing\n")
    rows = readers.manual_csv(spark, str(tmp_path))
    assert readers.converted(rows).first().first_shown == 1704153600
    assert tuple(readers.conversion_counts(rows).first()) == (1, 1, 1)


def test_merge_twice_changes_nothing(spark):
    kind = "advertiser_id string, ad_text string, image_url string"
    old = spark.createDataFrame([("a", "x", None), ("a", "y", ""), ("b", "z", "")], kind).withColumn("first_seen_date", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("last_seen_date", F.col("first_seen_date")).withColumn("is_active", F.lit(True))
    new = spark.createDataFrame([("a", "x", None), ("a", "n", None), (None, "q", None)], kind)
    once = tracking.upsert(old, new, "2024-02-01")
    assert sorted((r.ad_text, r.change) for r in once.collect()) == [("n", "new"), ("x", "updated"), ("y", "retired"), ("z", "kept")]
    twice = tracking.upsert(once.drop("change"), new, "2024-02-01")
    assert sorted(map(tuple, twice.drop("change").collect())) == sorted(map(tuple, once.drop("change").collect()))


def test_knowledge(spark):
    known = spark.createDataFrame([("Big Mac", "food", 0.9)], "product_name string, product_type string, confidence double")
    found = spark.createDataFrame([("Big Mac", "burger", 0.8), ("Whopper", "burger", 0.5)], "product_name string, product_type string, confidence double")
    assert [r.product_type for r in knowledge.upsert(known, found).collect()] == ["burger"]
    assert knowledge.lookup(spark.createDataFrame([("mac",)], "query string"), known).first().how == "contains"
    typed = spark.createDataFrame([("big mac", "unknown_category", 0.7)], "brand string, product_type string, confidence double")
    assert knowledge.gate(typed, known).first().product_type == "food"


def test_failing_rows_fall_back_alone(spark):
    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["a"] == 2).any():
            raise ValueError("no")
        return batch.assign(label="ok")

    out = labels.with_batches(spark.range(1, 4).toDF("a").coalesce(1), broken, "a long, label string, enrichment_error string", {"label": "none"}).collect()
    assert sorted((r.a, r.label, r.enrichment_error) for r in out) == [(1, "ok", None), (2, "none", "no"), (3, "ok", None)]


def test_search_ties_nulls_and_lengths(spark):
    rows = [(i, [1.0, 2.0]) for i in range(10)] + [(20, None), (21, [0.0, 0.0]), (22, [float("nan"), 1.0]), (23, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = knowledge.search(df.filter("vec_id IN (4, 20, 21)"), df, 3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(4, 1, 0), (4, 2, 1), (4, 3, 2)]
    assert knowledge.search(df.limit(0), df, 3).count() == 0


def test_containing_by_rarest_grams(spark):
    hays = spark.createDataFrame([("Red Widget",), ("bored",), ("x",), (None,), ("",)], "h string")
    needles = spark.createDataFrame([("red",), ("RE",), ("x",), ("widgets",), ("",), (None,)], "n string")
    got = sorted(map(tuple, containing(hays, "h", needles, "n").collect()))
    assert got == [("Red Widget", "RE"), ("Red Widget", "red"), ("bored", "RE"), ("bored", "red"), ("x", "x")]


def test_sections_of_replies(spark):
    names = ["visible_text", "product_service", "brand", "offers", "visual_elements"]
    reply = "1. ALL visible text:\nRafeeq\nFree delivery on your first order\n\n2. Product or service being advertised:\nFood delivery application\n\n5. Visual elements (colors):\nOrange background"
    found = one(spark, reply, lambda c: tx.sections(c, names))
    assert found == {"visible_text": "Rafeeq\nFree delivery on your first order", "product_service": "Food delivery application", "visual_elements": "Orange background"}
    assert one(spark, "1. The visible text in the image is:\nPro\nJoin now!\n\nMore details: it is an ad.", lambda c: tx.visible_text(c, names)) == "Pro\nJoin now!"
    assert one(spark, "Burger King\nOnly 25 QAR", lambda c: tx.visible_text(c, names)) == "Burger King\nOnly 25 QAR"


def test_images_and_tables(spark, tmp_path):
    (tmp_path / "AR1").mkdir()
    (tmp_path / "AR1" / "CR7.jpg").write_bytes(b"jpg")
    rows = spark.createDataFrame([("CR7",), ("CR8",)], "creative_id string")
    held = {r.creative_id: r.content for r in readers.with_images(rows, readers.images(spark, str(tmp_path))).collect()}
    assert held == {"CR7": bytearray(b"jpg"), "CR8": None}
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    readers.write_table(rows, url, "creatives")
    assert readers.table(spark, url, "creatives").count() == 2


def test_incremental_run_labels_new_ads_alone(spark):
    kind = "advertiser_id string, ad_text string, image_url string"
    old = spark.createDataFrame([("a", "x", "")], kind).withColumns({c: F.lit("2024-01-01").cast("timestamp_ntz") for c in ("first_seen_date", "last_seen_date")}).withColumn("is_active", F.lit(True))
    scraped = spark.createDataFrame([("a", "x", ""), ("a", "y", ""), ("b", "z", ""), ("b", "zz", "")], kind)
    versions, found, record = tracking.incremental_run(scraped, old, lambda rows: rows, "2024-02-01", batch=2)
    assert sorted(r.ad_text for r in found.collect()) == ["y", "z"] and versions.count() == 4
    assert sorted((r.advertiser_id, r.kind, r.ads_new) for r in record.collect()) == [("a", "update", 1), ("b", "first", 2)]


def test_shares_add_up_and_gaps(spark):
    ads = spark.createDataFrame([("a", "x", "none", True, None), ("b", "y", "bogo", True, None), ("b", "y", "bogo", True, False)], "advertiser_id string, product_category string, offer_type string, is_active boolean, rejected_wrong_region boolean").withColumn("offer_details", F.lit(None).cast("string"))
    assert abs(sum(r.percentage for r in insights.offers_breakdown(ads).collect()) - 100) < 0.2
    assert insights.missing_pairs(ads, "advertiser_id", "product_category").count() == 2
    assert reports.vulnerability(ads, "a", least_gap=0).first().leader == "b"


def test_ingest_check_and_split_ratio(spark):
    raw = spark.createDataFrame([("c1", "QA,AE", "A"), ("c1", None, None)], "creative_id string, regions string, advertiser_name string")
    found = {(r.metric, r.key): r.n for r in insights.ingest_check(raw, "QA").collect()}
    assert found[("region", "UNKNOWN")] == 1 and found[("repeated ids", "")] == 1
    runs = spark.createDataFrame([("p", i, 2.0, 1.0) for i in range(3)], "service_pair string, run int, slow_s double, fast_s double")
    assert [r.share for r in insights.split_ratio(runs).orderBy("run").collect()][-1] == pytest.approx(2 / 3)


def test_rows_beside_failing_ones_are_analysed_together(spark):
    """F4 of round 4: one failing row had every row of its batch analysed by itself."""

    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["a"] % 16 == 15).any():
            raise ValueError(f"no {batch['a'].max()}")
        return batch.assign(rows=len(batch))

    rows = spark.range(2000).toDF("a").coalesce(1)
    for parts in (None, 3):
        out = labels.with_batches(rows, broken, "a long, rows long, enrichment_error string", {"rows": -1}, parts).collect()
        assert sorted(r.a for r in out) == list(range(2000))
        assert all((r.rows == -1 and r.enrichment_error == f"no {r.a}") if r.a % 16 == 15 else (r.rows > 0 and r.enrichment_error is None) for r in out)
        assert sum(1 / r.rows for r in out if r.rows > 0) < 2000 / 3  # calls that succeeded; 1875 while rows went one by one


def test_batches_of_which_all_rows_fail(spark):
    def broken(batch: pd.DataFrame) -> pd.DataFrame:
        raise ValueError("no")

    out = labels.with_batches(spark.range(50).toDF("a"), broken, "a long, label string, enrichment_error string", {"label": "none"}).collect()
    assert sorted(tuple(r) for r in out) == [(a, "none", "no") for a in range(50)]


def test_replies_are_cut_into_lines_once(spark):
    """F5 of round 4: every section of every use went over all lines again."""
    from adsignal.plans import row_queries

    plan = row_queries.section_parse(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2 and plan.count("aggregate(") == 1  # the lines of the sections, and those of the whole reply


def test_odd_replies(spark):
    names = ["a", "b", "c"]
    cut = lambda text: one(spark, text, lambda c: tx.sections(c, names))
    assert cut(None) == cut("") == cut("no heading") == {}
    assert cut("lost\n2) B: x\r\n\r\ny\n1. A: **z**\n2. B: again\n9. none: n\n99999999999. D: big\n3. no colon") == {"a": "z", "b": "x\ny\nagain"}
    assert one(spark, "2. B: x\nNote: y\n z ", lambda c: tx.visible_text(c, names)) == "2. B: x\nz"
