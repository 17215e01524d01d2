"""The advertising tables, as views over the tables of a sales schema.

An advertiser is a nation, an ad a line item; nothing here is specific to the jobs, which take any tables of the same
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ads joined with their labels, one row an ad (no key: equal rows are different ads)."""
    t = {n: load(spark, sf_dir, n) for n in ("lineitem", "part", "supplier", "nation", "region", "orders", "customer")}
    sellers = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")
    audience = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_mktsegment")
    rows = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(audience, F.col("l_orderkey") == F.col("o_orderkey"))
    off = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    return rows.select(
        F.col("l_orderkey").alias("ad_order"),
        F.col("l_linenumber").alias("ad_line"),
        F.col("n_name").alias("advertiser_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_partkey").cast("string").alias("image_url"),
        F.col("l_shipdate").alias("first_seen_date"),
        (F.col("l_linestatus") == "O").alias("is_active"),
        F.col("p_type").alias("product_category"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("l_returnflag") == "R", "percentage_discount").when(F.col("l_returnflag") == "A", "free_delivery").otherwise("none").alias("offer_type"),
        F.when(F.col("l_returnflag") == "R", F.concat(off, F.lit("% off"))).alias("offer_details"),
        F.col("o_orderpriority").alias("primary_theme"),
        F.col("c_mktsegment").alias("audience_segment"),
        (F.col("r_name") == "ASIA").alias("rejected_wrong_region"),
    )


ADS_SQL = """ads AS (
SELECT l.l_orderkey AS ad_order, l.l_linenumber AS ad_line, n.n_name AS advertiser_id, l.l_suppkey AS seller_id,
       CAST(l.l_partkey AS VARCHAR) AS image_url, l.l_shipdate AS first_seen_date, (l.l_linestatus = 'O') AS is_active,
       p.p_type AS product_category, p.p_name AS product_name, p.p_brand AS brand,
       CASE l.l_returnflag WHEN 'R' THEN 'percentage_discount' WHEN 'A' THEN 'free_delivery' ELSE 'none' END AS offer_type,
       CASE WHEN l.l_returnflag = 'R' THEN concat(CAST(CAST(round(l.l_discount * 100) AS INTEGER) AS VARCHAR), '% off') END AS offer_details,
       o.o_orderpriority AS primary_theme, c.c_mktsegment AS audience_segment, (r.r_name = 'ASIA') AS rejected_wrong_region
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey),
valid AS (SELECT * FROM ads WHERE is_active AND NOT coalesce(rejected_wrong_region, false))"""


#: One ad text an order, of sixteen kinds; the same expression in both engines.
TEXT = """CASE o_orderkey % 16
  WHEN 0 THEN concat('Get ', o_custkey % 90 + 5, '% off your first order')
  WHEN 1 THEN concat('QAR ', o_custkey % 50 + 1, ' off orders above QAR ', o_custkey % 50 + 51)
  WHEN 2 THEN 'Free delivery in Doha, limited time'
  WHEN 3 THEN concat('Buy ', o_custkey % 3 + 1, ' get 1 free burger and fries at Tasty House')
  WHEN 4 THEN concat('خصم ', o_custkey % 60 + 1, '% شاورما')
  WHEN 5 THEN 'New menu item: pizza slice for family and kids'
  WHEN 6 THEN 'Special offer, today only'
  WHEN 7 THEN 'Order from Golden Spoon Kitchen online'
  WHEN 8 THEN concat('Made in Dubai with love, AED ', o_custkey % 100)
  WHEN 9 THEN 'see https://market.example/qatar/golden-spoon-2 today'
  WHEN 10 THEN 'MacDonalds combo for students on campus'
  WHEN 11 THEN 'talabat pro saves on delivery'
  WHEN 12 THEN '限时优惠 快来买'
  WHEN 13 THEN 'مطعم الشرق الكبير'
  WHEN 14 THEN 'pharmacy medicine and vitamin for the office'
  ELSE '' END"""

TEXTS_SQL = f"texts AS (SELECT o_orderkey AS ad_id, concat('adv', o_custkey % 7) AS advertiser_id, o_custkey AS c, o_orderkey % 16 AS k, o_orderdate AS at, {TEXT} AS ad_text FROM orders)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad texts: ad_id, advertiser_id, c (a number in the text), k (its kind), at, ad_text."""
    return load(spark, sf_dir, "orders").selectExpr("o_orderkey AS ad_id", "concat('adv', o_custkey % 7) AS advertiser_id", "o_custkey AS c", "o_orderkey % 16 AS k", "o_orderdate AS at", f"{TEXT} AS ad_text")
