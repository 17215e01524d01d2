"""Queries of the row functions, on links, html, dates and replies that are made of orders and pages in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gallery, insights, knowledge, tracking
from ..sources import readers
from .registry import register
from .views import load, texts

LINK = "concat('https://ads.example/advertiser/AR', o_custkey, '/creative/CR', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '?region=AE' WHEN 1 THEN '' ELSE '#top' END)"


@register("SELECT o_orderkey, 'AR' || o_custkey AS advertiser_id, 'CR' || o_orderkey AS creative_id, 'AR' || o_custkey AS code, CASE o_orderkey % 3 WHEN 0 THEN 'AE' ELSE 'QA' END AS region FROM orders", with_ads=False)
def link_parse(spark, sf):
    rows = load(spark, sf, "orders").selectExpr("o_orderkey", f"{LINK} AS link")
    advertiser, creative = tx.link_ids(F.col("link"))
    return rows.select("o_orderkey", advertiser.alias("advertiser_id"), creative.alias("creative_id"), tx.advertiser_code(F.col("link")).alias("code"), tx.url_parameter(F.col("link"), "region", "QA").alias("region"))


HTML = "CASE o_orderkey % 4 WHEN 0 THEN concat('<img src=\"https://i.example/', o_orderkey, '.png\" width=\"', w, '\" height=\"', h, '\">') WHEN 1 THEN concat('<iframe src = \"//v.example/', o_orderkey, '\">') WHEN 2 THEN 'no tag' ELSE '' END"
_WIDTH = "CASE o_custkey % 9 WHEN 0 THEN 300 WHEN 1 THEN 728 WHEN 2 THEN 160 WHEN 3 THEN 320 WHEN 4 THEN 300 WHEN 5 THEN 970 WHEN 6 THEN 400 WHEN 7 THEN 900 ELSE 500 END"
_HEIGHT = "CASE o_custkey % 9 WHEN 0 THEN 250 WHEN 1 THEN 90 WHEN 2 THEN 600 WHEN 3 THEN 50 WHEN 4 THEN 600 WHEN 5 THEN 250 WHEN 6 THEN 401 WHEN 7 THEN 300 ELSE 450 END"
_SHAPES = f"SELECT *, {_WIDTH} AS w, {_HEIGHT} AS h FROM orders"
_BUCKET = "CASE WHEN o_orderkey % 4 <> 0 THEN 'Unknown' ELSE CASE o_custkey % 9 WHEN 0 THEN 'Medium Rectangle' WHEN 1 THEN 'Leaderboard' WHEN 2 THEN 'Wide Skyscraper' WHEN 3 THEN 'Mobile Banner' WHEN 4 THEN 'Half Page' WHEN 5 THEN 'Billboard' WHEN 6 THEN 'Vertical' WHEN 7 THEN 'Banner' ELSE 'Square/Rectangle' END END"


def _shapes(spark, sf):
    return load(spark, sf, "orders").selectExpr("*", f"{_WIDTH} AS w", f"{_HEIGHT} AS h").withColumn("html", F.expr(HTML))


@register(f"""WITH o AS ({_SHAPES}) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'https://i.example/' || o_orderkey || '.png' WHEN 1 THEN '//v.example/' || o_orderkey WHEN 2 THEN 'no tag' ELSE '' END AS source, {_BUCKET} AS bucket,
CASE o_orderkey % 5 WHEN 1 THEN 'Text' WHEN 2 THEN 'Image' WHEN 3 THEN 'Video' ELSE 'Unknown (' || (o_orderkey % 5) || ')' END AS format_name, CASE WHEN o_orderkey % 4 = 0 THEN w END AS width, CASE WHEN o_orderkey % 4 = 0 THEN h END AS height,
CASE WHEN o_orderkey % 4 = 0 THEN 'Image' WHEN o_custkey % 2 = 0 THEN 'Text' ELSE 'Unknown' END AS format, CASE WHEN o_orderkey % 4 = 1 THEN 'Interactive' WHEN o_orderkey % 4 = 0 THEN 'Image' WHEN o_custkey % 2 = 0 THEN 'Text' ELSE 'Unknown' END AS shown_format FROM o""", with_ads=False)
def creative_parts(spark, sf):
    rows = _shapes(spark, sf)
    html = F.col("html")
    image, words = F.when(html.startswith("<img"), tx.image_source(html)), F.when(F.col("o_custkey") % 2 == 0, "text")
    size = F.concat(F.lit("https://i.example/?width="), F.regexp_extract(html, 'width="([0-9]+)"', 1), F.lit("&height="), F.regexp_extract(html, 'height="([0-9]+)"', 1))
    width, height = tx.dimensions(size)
    none = F.lit(None).cast("string")
    return rows.select(
        "o_orderkey",
        tx.image_source(html).alias("source"),
        tx.size_bucket(html).alias("bucket"),
        tx.format_name(F.col("o_orderkey") % 5).alias("format_name"),
        width.alias("width"),
        height.alias("height"),
        tx.format_of_creative(words, image, none).alias("format"),
        tx.format_of_creative(words, image, none, html.startswith("<iframe")).alias("shown_format"),
    )


@register(f"WITH o AS ({_SHAPES}) SELECT {_BUCKET} AS bucket, count(*) AS n FROM o GROUP BY 1", with_ads=False)
def format_histogram(spark, sf):
    return insights.format_histogram(_shapes(spark, sf), "html")


@register("""SELECT o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 11) AS video, 'https://www.youtube.com/watch?v=' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 11) AS watch, CASE o_orderpriority WHEN '1-URGENT' THEN 'State of Q' WHEN '2-HIGH' THEN 'Emirates' ELSE o_orderpriority END AS region,
300 + o_custkey % 50 AS width, 200 + o_custkey % 50 AS height FROM orders""", with_ads=False)
def video_links(spark, sf):
    kinds = "CASE o_orderkey % 4 WHEN 0 THEN concat('https://i.example/vi/', v, '/0.jpg') WHEN 1 THEN concat('https://www.example/watch?a=1&v=', v) WHEN 2 THEN concat('https://youtu.be/', v) ELSE concat('https://www.example/embed/', v, '?x') END"
    sizes = "CASE o_orderkey % 4 WHEN 0 THEN concat('https://i.example/a?w=', w, '&h=', h) WHEN 1 THEN concat('https://i.example/', w, 'x', h, '.png') WHEN 2 THEN concat('https://i.example/x=w', w, '-h', h) ELSE concat('https://i.example/', w, '×', h) END"
    rows = load(spark, sf, "orders").withColumn("v", F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 11)).withColumn("w", 300 + F.col("o_custkey") % 50).withColumn("h", 200 + F.col("o_custkey") % 50)
    rows = rows.withColumn("url", F.expr(kinds)).withColumn("size", F.expr(sizes))
    shown = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Shown in the ").otherwise("shown in "), "o_orderpriority")
    width, height = tx.dimensions(F.col("size"))
    region = tx.named(tx.region_text(shown), {"1-URGENT": "State of Q", "2-HIGH": "Emirates"})
    return rows.select("o_orderkey", tx.youtube_id(F.col("url")).alias("video"), tx.youtube_urls(tx.youtube_id(F.col("url")))[0].alias("watch"), region.alias("region"), width.cast("long").alias("width"), height.cast("long").alias("height"))


_DAYS = "o_orderkey % 800"


@register(f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first, CAST(o_orderdate AS DATE) + CAST({_DAYS} AS INTEGER) AS last, CASE WHEN {_DAYS} = 0 THEN 'Same day' WHEN {_DAYS} = 1 THEN '1 day' WHEN {_DAYS} < 30 THEN ({_DAYS}) || ' days' WHEN {_DAYS} < 365 THEN CAST(floor(({_DAYS}) / 30.0 + 0.5) AS BIGINT) || ' months' ELSE CAST(floor(({_DAYS}) / 365.0 + 0.5) AS BIGINT) || ' years' END AS duration,
CASE o_orderkey % 3 WHEN 2 THEN 'soon' ELSE strftime(o_orderdate, '%b %d, %Y') END AS shown, CASE o_orderkey % 3 WHEN 2 THEN '0001-01-01 00:00:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed FROM orders""", with_ads=False)
def date_parts(spark, sf):
    rows = load(spark, sf, "orders").withColumn("end", F.col("o_orderdate") + F.make_interval(days=F.expr(f"CAST({_DAYS} AS INT)")))
    span = F.concat(F.date_format("o_orderdate", "MMM d, yyyy"), F.lit(" - "), F.date_format("end", "MMM d, yyyy"))
    first, last = tx.date_range(span)
    k = F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    stamped = F.when(k == 2, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "Z").otherwise("")))
    return rows.select("o_orderkey", first.alias("first"), last.alias("last"), tx.duration_bucket(F.col("o_orderdate").cast("timestamp"), F.col("end").cast("timestamp")).alias("duration"), tx.display_date(stamped).alias("shown"), F.date_format(tx.any_timestamp(written), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register("""SELECT ad_id, CASE WHEN length(ad_text) = 0 THEN '' WHEN k IN (0, 9) THEN ad_text ELSE ad_text || chr(10) || repeat('z', greatest(1, length(ad_text) - 2)) END AS merged,
CAST(CASE WHEN length(ad_text) = 0 THEN 0.1 WHEN k IN (0, 9) THEN 0.85 ELSE 0.98 END AS DOUBLE) AS confidence, CASE WHEN length(ad_text) = 0 THEN 'Acme' ELSE 'Acme' || chr(10) || ad_text END AS composed,
'Acme' || '||' || ad_text || '||' AS signature, CASE WHEN k = 0 THEN 'Acme - Burgers' WHEN k = 1 THEN 'Acme - General' WHEN k = 2 THEN 'Pro' WHEN k = 3 THEN 'Burgers' WHEN k = 4 THEN 'General' ELSE 'Unknown' END AS name,
CASE k % 4 WHEN 0 THEN 'De''Longhi' WHEN 1 THEN 'Golden Spoon' WHEN 2 THEN 'Al-Rayan Mart' ELSE '' END AS trimmed FROM texts""", with_texts=True)
def text_parts(spark, sf):
    rows = texts(spark, sf).withColumn("who", F.lit("Acme")).withColumn("none", F.lit(None).cast("string"))
    k, t = F.col("k"), F.col("ad_text")
    other = F.when((F.length(t) == 0) | k.isin(0, 9), "").otherwise(F.repeat(F.lit("z"), F.greatest(F.lit(1), F.length(t) - 2)))
    inside = F.when(F.length(t) == 0, "").otherwise(F.substring(t, F.lit(2), F.length(t) - 2))
    parts = F.array(inside, t, other)
    has = lambda value, *kinds: F.when(k.isin(*kinds), value)
    name = tx.product_name(has("Acme", 0, 1), has("Burgers", 0, 3), has("General", 0, 1, 3, 4), has("Pro", 2))
    raw = F.when(k % 4 == 0, "DE'LONGHI ONLINE WITH ONE HOUR DELIVERY").when(k % 4 == 1, "- golden spoon, free today").when(k % 4 == 2, "al-rayan mart shop now").otherwise("Order now")
    trimmed = tx.trimmed_name(F.regexp_replace(raw, ",", ""), ["online", "free", "shop", "order"])
    return rows.select(
        "ad_id",
        tx.merged_transcripts(parts).alias("merged"),
        tx.sources_confidence(parts).alias("confidence"),
        tx.composed(F.array(F.lit(" Acme "), t, F.lit("ACME"), F.upper(t))).alias("composed"),
        tracking.signature("who", "ad_text", "none").alias("signature"),
        name.alias("name"),
        trimmed.alias("trimmed"),
    )


#: The sections that replies are asked for, by number.
SECTIONS = ["visible_text", "product_service", "brand", "offers", "visual_elements"]
REPLY = "concat('1. ALL visible text:', chr(10), ad_text, chr(10), 'The ad shows food', chr(10), chr(10), '2. Product or service being advertised: food', chr(10), '3. **Brand:** Acme', chr(10), 'More details: none', chr(10), '7. Other: x')"


@register("""SELECT ad_id, CASE WHEN ad_text = '' THEN '1. ALL visible text:' || chr(10) || '2. Product or service being advertised: food' || chr(10) || '3. **Brand:** Acme' || chr(10) || '7. Other: x' ELSE ad_text END AS visible, 'food' AS product, 'Acme' AS brand, CASE WHEN ad_text = '' THEN 2 ELSE 3 END AS n FROM texts""", with_texts=True)
def section_parse(spark, sf):
    rows = texts(spark, sf).withColumn("reply", F.expr(REPLY))
    rows, found = rows.withColumn("found", tx.sections(F.col("reply"), SECTIONS)), F.col("found")
    return rows.select("ad_id", tx.visible_text(F.col("reply"), SECTIONS, found=found).alias("visible"), found["product_service"].alias("product"), found["brand"].alias("brand"), F.size(found).alias("n"))


@register("""WITH k AS (SELECT p_name, min(p_type) AS product_type, CAST(0.8 AS DOUBLE) AS confidence FROM part GROUP BY 1)
SELECT p_name AS id, p_name || ' is a ' || product_type || ' product in the category Unknown.' AS document, '{"product_type":"' || product_type || '","category":"Unknown"}' AS metadata FROM k""", with_ads=False)
def knowledge_documents(spark, sf):
    rows = load(spark, sf, "part").select(F.col("p_name").alias("product_name"), F.col("p_type").alias("product_type"), F.lit(None).cast("string").alias("category"), F.lit(0.5).alias("confidence"))
    best = rows.groupBy("product_name").agg(F.min("product_type").alias("product_type"), F.min("category").alias("category")).withColumn("confidence", F.lit(0.8))
    return knowledge.documents(knowledge.upsert(rows.dropDuplicates(["product_name"]), best))


@register("""SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '' ELSE url || chr(10) || 'end' END) AS raw_text FROM pages WHERE page_id % 3 <> 1 AND url IS NOT NULL""", with_ads=False)
def raw_texts(spark, sf):
    k = F.col("page_id") % 3
    rows = load(spark, sf, "pages").filter("url IS NOT NULL").withColumn("ad_text", F.when(k != 1, F.col("url"))).withColumn("html_content", F.when(k == 2, "end").when(k == 1, ""))
    return readers.usable_text(rows).select("page_id", "raw_text")


@register("SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 5 IN (0, 1)", with_ads=False)
def kept_creatives(spark, sf):
    """Creatives of a region, and not empty."""
    rows = load(spark, sf, "orders").withColumn("region_list", F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("AE"), F.lit("QA"))).when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 5 != 1, F.array(F.lit("AE"))))
    rows = rows.withColumn("image_url", F.when(F.col("o_orderkey") % 2 == 0, "i")).withColumn("video_url", F.lit(None).cast("string")).withColumn("ad_text", F.when(F.col("o_orderkey") % 2 == 1, "t")).withColumn("has_iframe", F.lit(None).cast("boolean"))
    return readers.not_empty(readers.in_region(rows, "QA")).select("o_orderkey")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 OR o_custkey % 2 = 0", with_ads=False)
def filled_creatives(spark, sf):
    """Creatives without an image or text stay only in an iframe."""
    rows = load(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 1, "i").alias("image_url"), F.when(F.col("o_orderkey") % 4 == 2, "v").alias("video_url"), F.when(F.col("o_orderkey") % 4 == 3, "t").alias("ad_text"), (F.col("o_custkey") % 2 == 0).alias("has_iframe"))
    return readers.not_empty(rows).select("o_orderkey")


@register("SELECT page_id, 'https://www.youtube.com/watch?v=' AS start, length(url) AS n FROM pages WHERE contains(lower(url), 'th')", with_ads=False)
def named_pages(spark, sf):
    return insights.named_like(load(spark, sf, "pages"), "url", "TH").select("page_id", F.lit("https://www.youtube.com/watch?v=").alias("start"), F.length("url").cast("long").alias("n"))


@register("SELECT p_partkey FROM part WHERE contains(p_type, 'ECON') OR contains(p_type, 'SMALL')", with_ads=False)
def parts_of_categories(spark, sf):
    return insights.of_categories(load(spark, sf, "part"), "p_type", ["ECON", "SMALL"]).select("p_partkey")


@register("""SELECT o.o_orderkey AS ad_id, l.product_category, l.n FROM orders o LEFT JOIN (SELECT o_orderkey, o_orderpriority AS product_category, o_orderkey % 9 = 0 AS rejected, CAST(o_custkey AS DOUBLE) AS n FROM orders WHERE o_orderkey % 4 <> 0) l ON l.o_orderkey = o.o_orderkey
WHERE o.o_orderstatus <> 'F' AND NOT coalesce(l.rejected, false)""", with_ads=False)
def enriched_view(spark, sf):
    orders = load(spark, sf, "orders")
    ads = orders.select(F.col("o_orderkey").alias("ad_id"), F.concat(F.lit("adv"), F.col("o_custkey") % 7).alias("advertiser_id"), (F.col("o_orderstatus") != "F").alias("is_active"))
    own = orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("ad_id"), F.col("o_orderpriority").alias("product_category"), (F.col("o_orderkey") % 9 == 0).alias("rejected_wrong_region"), F.concat(F.lit('{"n": '), "o_custkey", F.lit("}")).alias("messaging_themes"))
    return gallery.enriched(ads, own).select("ad_id", "product_category", F.col("messaging_themes")["n"].alias("n"))


@register("SELECT o_orderkey AS ad_id FROM orders WHERE o_custkey % 7 = 3 AND NOT (o_orderkey % 4 <> 0 AND o_orderkey % 9 = 0)", with_ads=False)
def enriched_advertiser(spark, sf):
    orders = load(spark, sf, "orders")
    ads = orders.select(F.col("o_orderkey").alias("ad_id"), F.concat(F.lit("adv"), F.col("o_custkey") % 7).alias("advertiser_id"), F.lit(False).alias("is_active"))
    own = orders.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("ad_id"), (F.col("o_orderkey") % 9 == 0).alias("rejected_wrong_region"))
    return gallery.enriched(ads, own, advertiser="adv3", active_only=False).select("ad_id")


@register("""SELECT page_id, CAST(x AS BIGINT) AS n, 'c' || (page_id % 3) AS name FROM pages, range(3) t(x) WHERE x <= page_id % 3""", with_ads=False)
def json_arrays(spark, sf):
    """Replies that hold a JSON array, in a fence with words around it: one row an element."""
    item = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int")), lambda n: F.struct(n.alias("n"), F.concat(F.lit("c"), F.col("page_id") % 3).alias("name")))
    rows = load(spark, sf, "pages").select("page_id", F.concat(F.lit("Here it is:\n```json\n"), F.to_json(item), F.lit("\n```\nDone.")).alias("reply"))
    return rows.select("page_id", F.explode(tx.json_array_in_reply(F.col("reply"), "array<struct<n:long,name:string>>")).alias("x")).select("page_id", "x.n", "x.name")
