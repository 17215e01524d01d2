"""Queries of the labels, over one text an order.  Their SQL states by kind of text (k) what each label must be."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import lexicon, similar
from ..operators import insights, labels
from .registry import register
from .views import load, texts


def _by_kind(cases: dict[int, str], other: str) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


_REGION = _by_kind({12: "'INVALID'", 8: "'AE'"}, "'QA'")
_REGION_SURE = f"CAST({_by_kind({12: '0.98', 8: '0.95', 1: '0.75', 2: '0.7', 9: '0.7'}, '0.4')} AS DOUBLE)"
_OFFER = _by_kind({0: "'percentage_discount'", 1: "'fixed_discount'", 2: "'free_delivery'", 3: "'bogo'", 4: "'percentage_discount'", 5: "'new_product'", 6: "'special_offer'"}, "'none'")
_DETAILS = _by_kind({0: "(c % 90 + 5) || '% off'", 1: "'QAR ' || (c % 50 + 1) || ' off'", 2: "'Free delivery'", 3: "'Buy one, get one offer'", 4: "(c % 60 + 1) || '% off'", 5: "'New product/menu item'", 6: "'Special offer (details unclear)'"}, "''")
_CONDITIONS = _by_kind({0: "'first order only'", 1: "'min order QAR ' || (c % 50 + 51)", 2: "'limited time'"}, "''")
_OFFER_SURE = f"CAST({_by_kind({0: '0.92', 1: '0.9', 2: '0.95', 3: '0.88', 4: '0.92', 5: '0.75', 6: '0.6'}, '0.95')} AS DOUBLE)"
_SIGNAL = _by_kind({0: "'percentage_discount:' || (c % 90 + 5)", 1: "'fixed_discount:' || (c % 50 + 1)", 4: "'percentage_discount:' || (c % 60 + 1)"}, _OFFER)
_THEME = _by_kind({1: "'convenience'", 2: "'convenience'", 5: "'variety'", 7: "'convenience'"}, "'price'")
_OFF = "CASE k WHEN 0 THEN c % 90 + 5 WHEN 4 THEN c % 60 + 1 ELSE 0 END"
_AUDIENCE = f"CASE WHEN k = 5 THEN 'Families' WHEN k = 10 THEN 'Students' WHEN k = 14 THEN 'Professionals' WHEN {_OFF} >= 40 THEN 'Budget-Conscious' ELSE 'General Audience' END"
_AUDIENCE_SURE = f"CAST(CASE WHEN k IN (5, 10) THEN 0.9 WHEN k = 14 THEN 0.8 WHEN {_OFF} >= 40 THEN 0.75 ELSE 0.6 END AS DOUBLE)"
_FOOD = _by_kind({3: "'Burgers'", 4: "'Shawarma & Street Food'", 5: "'Pizza'"}, "NULL")


def _region(spark, sf):
    return texts(spark, sf).withColumn("r", labels.region(F.col("ad_text")))


@register(f"SELECT ad_id, {_REGION} AS detected, {_REGION_SURE} AS confidence, k NOT IN (8, 12) AS is_valid, {_by_kind({12: chr(39) + 'Chinese' + chr(39), 8: chr(39) + 'aed|dubai' + chr(39)}, chr(39) * 2)} AS mismatches, k <> 8 AS only_region FROM texts", with_texts=True)
def region_labels(spark, sf):
    return _region(spark, sf).select("ad_id", "r.detected", "r.confidence", "r.is_valid", F.array_join("r.mismatches", "|").alias("mismatches"), labels.only_region(F.col("ad_text"), ["dubai", "aed"]).alias("only_region"))


@register(f"SELECT count(*) FILTER (WHERE k NOT IN (8, 12)) AS valid, count(*) FILTER (WHERE k IN (8, 12)) AS rejected, round(avg({_REGION_SURE}), 3) AS mean_confidence FROM texts", with_texts=True)
def region_acceptance(spark, sf):
    return insights.acceptance(_region(spark, sf).select("r.is_valid", "r.confidence"))


@register(f"SELECT ad_id, CASE k WHEN 0 THEN 2 ELSE 1 END AS n, {_OFFER} AS type, {_DETAILS} AS details, {_CONDITIONS} AS conditions, {_OFFER_SURE} AS confidence, {_SIGNAL} AS signal FROM texts", with_texts=True)
def offer_labels(spark, sf):
    found = texts(spark, sf).withColumn("o", labels.offers(F.col("ad_text")))
    first = F.col("o")[0]
    return found.select("ad_id", F.size("o").alias("n"), first["type"].alias("type"), first["details"].alias("details"), first["conditions"].alias("conditions"), first["confidence"].alias("confidence"), F.array_join(first["signals"], "|").alias("signal"))


@register(f"SELECT ad_id, {_THEME} AS primary_theme, CAST({_by_kind({0: '0.85', 2: '0.85', 3: '0.85', 4: '0.85', 5: '0.95', 7: '0.85'}, '0.7')} AS DOUBLE) AS confidence, {_by_kind({14: chr(39) + 'pharmacy' + chr(39)}, chr(39) + 'restaurant' + chr(39))} AS vertical FROM texts", with_texts=True)
def theme_labels(spark, sf):
    found = texts(spark, sf).withColumn("t", labels.themes(F.col("ad_text"), labels.offers(F.col("ad_text"))[0]["type"]))
    return found.select("ad_id", F.col("t.primary").alias("primary_theme"), "t.confidence", labels.vertical(F.col("ad_text")).alias("vertical"))


@register(f"SELECT ad_id, {_AUDIENCE} AS segment, {_AUDIENCE_SURE} AS confidence FROM texts", with_texts=True)
def audience_labels(spark, sf):
    found = texts(spark, sf).withColumn("o", labels.offers(F.col("ad_text"))[0])
    off = F.regexp_extract("o.details", r"(\d+)%", 1).try_cast("int")
    return found.withColumn("a", labels.audience(F.col("ad_text"), F.col("o.type"), off)).select("ad_id", "a.segment", "a.confidence")


def _subscriptions(spark):
    return spark.createDataFrame([("adv1", "Talabat Pro", ["pro"], ["talabat"], True), ("adv2", "Off", ["pro"], ["talabat"], False)], labels.NO_SUBSCRIPTIONS)


@register("SELECT ad_id, CASE WHEN k = 11 AND advertiser_id = 'adv1' THEN 'Talabat Pro' END AS subscription_name, CAST(CASE WHEN advertiser_id <> 'adv1' THEN 0 WHEN k = 11 THEN 0.95 ELSE 0.05 END AS DOUBLE) AS subscription_confidence FROM texts", with_texts=True)
def subscription_labels(spark, sf):
    return labels.subscription(texts(spark, sf), _subscriptions(spark)).select("ad_id", "subscription_name", "subscription_confidence")


def _types(spark, sf):
    found = texts(spark, sf).withColumn("t", labels.product_type(F.col("ad_text"), F.lit(None).cast("string"), F.lit(0.0)))
    return found.withColumn("f", labels.food(F.col("ad_text"), F.lit(None).cast("string")))


@register("SELECT ad_id, CASE k WHEN 14 THEN 'pharmacy' ELSE 'restaurant' END AS type, CAST(CASE k WHEN 14 THEN 0.85 ELSE 0.4 END AS DOUBLE) AS confidence FROM texts", with_texts=True)
def product_type_labels(spark, sf):
    return _types(spark, sf).select("ad_id", "t.type", "t.confidence")


@register(f"SELECT ad_id, {_FOOD} AS category, CAST({_by_kind({3: '0.95', 4: '0.9', 5: '0.95'}, '0')} AS DOUBLE) AS confidence, {_by_kind({3: chr(39) + 'Burgers' + chr(39), 5: chr(39) + 'Pizza' + chr(39)}, 'NULL')} AS first_category, CAST({_by_kind({3: '0.85', 5: '0.9'}, '0')} AS DOUBLE) AS first_confidence FROM texts", with_texts=True)
def food_labels(spark, sf):
    first = labels.food_first(F.col("ad_text"), F.lit(None).cast("string"), {"Burgers": ["burger"], "Pizza": ["pizza", "slice"]}, {"Chipotle": "Mexican"})
    return _types(spark, sf).withColumn("g", first).select("ad_id", "f.category", "f.confidence", F.col("g.category").alias("first_category"), F.col("g.confidence").alias("first_confidence"))


@register(f"SELECT ad_id, CASE k WHEN 3 THEN 'Fast Food' WHEN 5 THEN 'Italian' ELSE 'Meal Deals & Combos' END AS product_category, {_by_kind({0: chr(39) + 'price' + chr(39), 5: chr(39) + 'variety' + chr(39), 11: chr(39) + 'price' + chr(39)}, chr(39) + 'convenience' + chr(39))} AS primary_theme, CAST(0.3 AS DOUBLE) AS confidence, CASE {_OFFER} WHEN 'none' THEN 'brand_awareness' ELSE {_OFFER} END AS simple_theme FROM texts", with_texts=True)
def fallback_labels(spark, sf):
    found = texts(spark, sf).withColumn("x", labels.fallback_label(F.col("ad_text"), {"Fast Food": ["burger", "fries"], "Italian": ["pizza"]}))
    simple = labels.simple_label(labels.offers(F.col("ad_text"))[0]["type"], F.lit(None).cast("string"))
    return found.select("ad_id", "x.product_category", "x.primary_theme", "x.confidence", simple["primary_theme"].alias("simple_theme"))


@register("SELECT ad_id, CASE k WHEN 14 THEN '' ELSE 'restaurant without brand|low confidence' END AS issues FROM texts", with_texts=True)
def label_audit(spark, sf):
    return _types(spark, sf).select("ad_id", F.array_join(labels.audit(F.col("t.type"), F.when(F.col("t.type") == "restaurant", F.col("f.category")), F.lit(None).cast("string"), F.col("t.confidence")), "|").alias("issues"))


CATALOG = [("McDonald's", "McDonald's", "restaurant", 2), ("McDonald's", "mcdonalds", "restaurant", 2), ("Tasty House", "tasty house", "restaurant", 1), ("Tasty House", "tasty", "restaurant", 1), ("Talabat", "talabat", "platform", 0)]


def _catalog(spark):
    return spark.createDataFrame(CATALOG, labels.NO_CATALOG)


@register("SELECT ad_id, 'Tasty House' AS brand, 'tasty house' AS alias, 'catalog' AS source, CAST(0.92 AS DOUBLE) AS confidence FROM texts WHERE k = 3 UNION ALL SELECT ad_id, 'McDonald''s', 'macdonalds', 'catalog_fuzzy', CAST(0.822 AS DOUBLE) FROM texts WHERE k = 10", with_texts=True)
def brand_catalog(spark, sf):
    return labels.brand_scan(texts(spark, sf), _catalog(spark), "ad_id").select("ad_id", "brand", "alias", "source", "confidence")


@register("""SELECT ad_id, CASE k WHEN 3 THEN 'Tasty House' WHEN 4 THEN 'خصم|شاورما' WHEN 7 THEN 'Golden Spoon Kitchen' WHEN 9 THEN 'Golden Spoon 2' ELSE 'مطعم الشرق الكبير' END AS names,
CASE k WHEN 3 THEN 'said' WHEN 4 THEN 'arabic|arabic' WHEN 7 THEN 'said' WHEN 9 THEN 'link' ELSE 'arabic' END AS sources, CAST(CASE k WHEN 3 THEN 0.9 WHEN 4 THEN 0.75 WHEN 7 THEN 0.95 WHEN 9 THEN 0.77 ELSE 0.75 END AS DOUBLE) AS confidence FROM texts WHERE k IN (3, 4, 7, 9, 13)""", with_texts=True)
def brand_unknown(spark, sf):
    found = texts(spark, sf).withColumn("b", labels.unknown_brands(F.col("ad_text"), None, [n for n, *_ in CATALOG], ["Talabat"])).filter(F.size("b") > 0)
    return found.select("ad_id", F.array_join(F.transform("b", lambda m: m["name"]), "|").alias("names"), F.array_join(F.transform("b", lambda m: m["source"]), "|").alias("sources"), F.col("b")[0]["confidence"].alias("confidence"))


def _resolve(asked):
    return asked.filter("ad_text LIKE 'Special%' OR ad_text LIKE '%Tasty%'").select("ad_id", F.lit("Resolved Brand").alias("brand"), F.lit(0.8).cast("double").alias("confidence"))


_BRAND = """CASE WHEN advertiser_id = 'adv3' THEN 'Tasty House' WHEN k = 3 THEN 'Tasty House' WHEN k = 10 THEN 'McDonald''s' WHEN k = 4 THEN 'خصم' WHEN k = 7 THEN 'Golden Spoon Kitchen' WHEN k = 9 THEN 'Golden Spoon 2' WHEN k = 13 THEN 'مطعم الشرق الكبير' END"""


@register(f"SELECT ad_id, CASE WHEN k = 6 AND advertiser_id <> 'adv3' THEN 'Resolved Brand' ELSE {_BRAND} END AS brand, advertiser_id = 'adv3' AND k <> 3 AS brand_inferred, advertiser_id = 'adv3' AND k IN (6, 7, 10) AS brand_conflict FROM texts", with_texts=True)
def brand_hints(spark, sf):
    hints = spark.createDataFrame([("adv3", ["Tasty House"])], "advertiser_id string, brands array<string>")
    found = labels.brands_of(texts(spark, sf), _catalog(spark), "ad_id", "ad_text", hints, _resolve)
    return found.select("ad_id", "brand", "brand_inferred", "brand_conflict")


_TYPE = "CASE WHEN k = 14 THEN 'pharmacy' WHEN k = 7 AND advertiser_id <> 'adv3' THEN 'grocery' WHEN k = 11 AND advertiser_id = 'adv1' THEN 'subscription' ELSE 'restaurant' END"


@register(f"""SELECT ad_id, {_REGION} AS detected_region, k IN (8, 12) AS rejected_wrong_region, CASE WHEN k NOT IN (8, 12) THEN {_TYPE} END AS product_type, CASE WHEN k NOT IN (8, 12) THEN CASE WHEN k = 7 AND advertiser_id <> 'adv3' THEN 'knowledge' ELSE 'rules' END END AS type_source,
CASE WHEN k NOT IN (8, 12) THEN {_FOOD} END AS food_category, CASE WHEN k NOT IN (8, 12) THEN {_BRAND} END AS brand, CASE WHEN k NOT IN (8, 12) THEN {_OFFER} END AS offer_type, CASE WHEN k NOT IN (8, 12) THEN {_DETAILS} END AS offer_details,
CASE WHEN k NOT IN (8, 12) THEN {_THEME} END AS primary_theme, CASE WHEN k NOT IN (8, 12) THEN {_AUDIENCE} END AS audience_segment, CASE WHEN k = 11 AND advertiser_id = 'adv1' THEN 'Talabat Pro' END AS subscription_name,
CASE WHEN k IN (8, 12) THEN NULL WHEN {_BRAND} IS NOT NULL THEN {_BRAND} || ' - ' || coalesce({_FOOD}, CASE {_TYPE} WHEN 'pharmacy' THEN 'Pharmacy & Health' WHEN 'grocery' THEN 'Grocery Delivery' WHEN 'restaurant' THEN 'Specific Restaurant/Brand Promo' ELSE 'Meal Deals & Combos' END)
 WHEN k = 11 AND advertiser_id = 'adv1' THEN 'Talabat Pro' ELSE coalesce({_FOOD}, CASE {_TYPE} WHEN 'pharmacy' THEN 'Pharmacy & Health' WHEN 'restaurant' THEN 'Specific Restaurant/Brand Promo' ELSE 'Meal Deals & Combos' END) END AS product_name FROM texts""", with_texts=True)
def label_chain(spark, sf):
    hints = spark.createDataFrame([("adv3", ["Tasty House"])], "advertiser_id string, brands array<string>")
    known = spark.createDataFrame([("Golden Spoon Kitchen", "grocery", 0.9)], labels.NO_KNOWLEDGE)
    found = labels.enrich(texts(spark, sf), catalog=_catalog(spark), subscriptions=_subscriptions(spark), hints=hints, known=known)
    return found.select("ad_id", "detected_region", "rejected_wrong_region", "product_type", "type_source", "food_category", "brand", "offer_type", "offer_details", "primary_theme", "audience_segment", "subscription_name", "product_name")


def _analysed(batch: pd.DataFrame) -> pd.DataFrame:
    if (batch["ad_text"] == "").any():
        raise ValueError("no text")
    return batch.assign(label=batch["ad_text"].str.slice(0, 3))


@register("SELECT ad_id, CASE WHEN k = 15 THEN 'none' ELSE substr(ad_text, 1, 3) END AS label, CASE WHEN k = 15 THEN 'no text' END AS enrichment_error FROM texts", with_texts=True)
def custom_analyser(spark, sf):
    rows = texts(spark, sf).select("ad_id", "ad_text")
    return labels.with_batches(rows, _analysed, "ad_id long, ad_text string, label string, enrichment_error string", {"label": "none"}, int(spark.conf.get("spark.sql.shuffle.partitions"))).select("ad_id", "label", "enrichment_error")


@register("SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '([0-9]+)[ \\t\\n]*%[ \\t\\n]*(?:off|discount)')) + len(regexp_extract_all(lower(coalesce(text, '')), 'save[ \\t\\n]*([0-9]+)[ \\t\\n]*%')) AS percents FROM documents", with_ads=False)
def offers_in_documents(spark, sf):
    found = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.size(F.filter(labels.offers(F.col("text")), lambda o: o["type"] == "percentage_discount")).cast("long").alias("percents"))
    return found


_WORDS = """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), w AS (SELECT DISTINCT item_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS term FROM benchmark), k AS (SELECT DISTINCT term FROM w WHERE length(term) > 3),
h AS (SELECT doc_id, term, (length(t) - length(replace(t, term, ''))) // length(term) AS n, instr(t, term) - 1 AS first_at FROM d JOIN k ON contains(t, term))"""


def _benchmark_words(spark, sf):
    rows = load(spark, sf, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term"))
    return rows.filter(F.length("term") > 3)


@register(_WORDS + " SELECT doc_id, term, n, first_at FROM h", with_ads=False)
def lexicon_hits(spark, sf):
    """Every word of the benchmark in every document: a thousand terms and more, one pass."""
    return lexicon.term_hits(load(spark, sf, "documents").select("doc_id", "text"), "text", _benchmark_words(spark, sf))


@register(_WORDS + """, s AS (SELECT doc_id, item_id, count(*) AS hits, CAST(sum(length(w.term)) AS DOUBLE) AS score FROM h JOIN w USING (term) GROUP BY ALL)
SELECT doc_id, arg_min(item_id, (-score, item_id)) AS name, arg_min(hits, (-score, item_id)) AS hits, max(score) AS score FROM s WHERE score >= 100 GROUP BY 1""", with_ads=False)
def lexicon_labels(spark, sf):
    """The item whose words a document holds most of, by letters: labels from a table of terms with weights."""
    entries = _benchmark_words(spark, sf).select(F.col("item_id").alias("name"), "term", F.length("term").alias("weight"))
    return lexicon.best_names(load(spark, sf, "documents"), ["doc_id"], "text", entries, least=100.0)


@register("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT DISTINCT substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2 - p_partkey % 2) || CASE p_partkey % 3 WHEN 0 THEN 'e' ELSE '' END AS text FROM part)
SELECT text, name, levenshtein(text, name) AS distance FROM t JOIN n ON text <> name AND abs(length(text) - length(name)) <= 2 AND levenshtein(text, name) <= 2""", with_ads=False)
def names_within_edits(spark, sf):
    """Altered product names against all names, at most two edits apart."""
    part = load(spark, sf, "part")
    altered = part.selectExpr("concat(substr(p_name, 1, p_partkey % length(p_name)), substr(p_name, cast(p_partkey % length(p_name) + 2 - p_partkey % 2 AS int)), CASE p_partkey % 3 WHEN 0 THEN 'e' ELSE '' END) AS text", "0 AS kind")
    return similar.within_edits(altered, part.selectExpr("p_name AS name", "0 AS kind"), 2).withColumn("distance", F.col("distance").cast("long"))
