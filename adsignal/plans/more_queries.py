"""Queries of windows, copies, queues, whole runs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights as i
from ..operators import knowledge, labels, reports, tracking
from ..sources.scratch import scratch
from ..streaming import jobs
from .catalogue import AS_OF, OWN, _snapshots
from .registry import register
from .views import ads, load, texts


@register(""", r AS (SELECT * FROM valid WHERE first_seen_date >= TIMESTAMP '2001-12-01' - INTERVAL 90 DAY), c AS (SELECT advertiser_id, primary_theme AS theme, count(*) AS n FROM r GROUP BY ALL)
SELECT *, CAST(trunc(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY advertiser_id) * 100) AS INTEGER) AS pct FROM c""")
def theme_share_recent(spark, sf):
    return i.theme_share(ads(spark, sf), [], "quarter", AS_OF).filter("theme IS NOT NULL")


@register("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY", with_ads=False)
def retained_history(spark, sf):
    return tracking.retention(load(spark, sf, "events"), "ts", "2024-01-31", 10).select("event_id")


@register("SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 50", with_ads=False)
def random_sample(spark, sf):
    return tracking.random_sample(load(spark, sf, "orders"), "o_orderkey", 50, 7).select("o_orderkey")


@register("""WITH o AS (SELECT o_orderkey AS ad_id, o_orderpriority AS product_category, o_orderstatus AS brand, o_orderkey % 10 = 1 AS manually_edited FROM orders WHERE o_orderkey % 4 <> 0),
n AS (SELECT o_orderkey AS ad_id, CASE WHEN o_orderkey % 6 <> 0 THEN 'New' END AS product_category, CASE WHEN o_orderkey % 18 <> 0 THEN 'B' ELSE '' END AS brand FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(o.ad_id, n.ad_id) AS ad_id, CASE WHEN n.ad_id IS NOT NULL AND NOT coalesce(o.manually_edited, false) THEN n.product_category ELSE o.product_category END AS product_category,
CASE WHEN n.ad_id IS NOT NULL AND NOT coalesce(o.manually_edited, false) THEN n.brand ELSE o.brand END AS brand, coalesce(o.manually_edited, false) AS manually_edited
FROM o FULL OUTER JOIN (SELECT * FROM n WHERE coalesce(nullif(product_category, ''), nullif(brand, '')) IS NOT NULL) n ON o.ad_id = n.ad_id""", with_ads=False)
def upsert_labels(spark, sf):
    orders, key = load(spark, sf, "orders"), F.col("o_orderkey")
    old = orders.filter(key % 4 != 0).select(key.alias("ad_id"), F.col("o_orderpriority").alias("product_category"), F.col("o_orderstatus").alias("brand"), (key % 10 == 1).alias("manually_edited"))
    new = orders.filter(key % 3 == 0).select(key.alias("ad_id"), F.when(key % 6 != 0, "New").alias("product_category"), F.when(key % 18 != 0, "B").otherwise("").alias("brand"))
    return tracking.upsert_labels(old, new, "ad_id", ["product_category", "brand"], ["product_category", "brand"])


@register("SELECT count(*) AS total, count(*) FILTER (WHERE p_type = 'ECONOMY') AS restaurant, count(*) FILTER (WHERE p_size > 25) AS subscription, CAST(0 AS BIGINT) AS unknown_category, round(avg(p_size / 50.0), 3) AS mean_confidence FROM part", with_ads=False)
def knowledge_stats(spark, sf):
    part = load(spark, sf, "part")
    return knowledge.stats(part.select((F.col("p_type") == "ECONOMY").alias("is_restaurant"), (F.col("p_size") > 25).alias("is_subscription"), F.lit(None).cast("boolean").alias("is_unknown_category"), (F.col("p_size") / 50.0).alias("confidence")))


@register("SELECT offer_type, count(*) FILTER (WHERE advertiser_id = 'NATION_1') AS own, count(*) FILTER (WHERE advertiser_id <> 'NATION_1') AS others FROM ads WHERE first_seen_date >= TIMESTAMP '1998-06-01' AND first_seen_date < TIMESTAMP '1998-06-02' GROUP BY 1")
def day_breakdown(spark, sf):
    return reports.day_breakdown(ads(spark, sf), OWN, "1998-06-01")


@register(", c AS (SELECT advertiser_id, count(*) AS n FROM valid WHERE product_category = 'ECONOMY' GROUP BY 1), o AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS own FROM c WHERE advertiser_id = 'NATION_1') SELECT advertiser_id, n, own, n - own AS gap, CASE WHEN own > 0 THEN round(CAST(n AS DOUBLE) / own, 2) END AS ratio FROM c, o WHERE advertiser_id <> 'NATION_1'")
def single_category(spark, sf):
    return reports.single_category(ads(spark, sf), OWN, "ECONOMY")


@register("""WITH t AS (SELECT 'words' AS metric, unnest(string_split(p_name, ' ')) AS raw FROM part UNION ALL SELECT 'names', upper(p_name) || ' ' FROM part), c AS (SELECT metric, trim(lower(raw)) AS key, count(*) AS n FROM t WHERE length(raw) > 2 GROUP BY ALL),
k AS (SELECT metric, count(*) AS kinds FROM c GROUP BY 1) SELECT metric, key, n, kinds FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY n DESC, key) AS r FROM c) JOIN k USING (metric) WHERE r <= 20""", with_ads=False)
def campaign_terms(spark, sf):
    part = load(spark, sf, "part").select(F.split("p_name", " ").alias("keywords"), F.array(F.concat(F.upper("p_name"), F.lit(" "))).alias("products"))
    return i.campaign_terms(part, {"words": "keywords", "names": "products"})


@register(""", l AS (SELECT 'offer_type' AS metric, offer_type AS key FROM ads UNION ALL SELECT 'product_category', product_category FROM ads), g AS (SELECT metric, key, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ads), 1) AS pct FROM l GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY n DESC, key) AS r FROM g) SELECT (SELECT 'offer_type: ' || string_agg(printf('%s (%.1f%%)', key, pct), ', ' ORDER BY r) FROM t WHERE metric = 'offer_type' AND r <= 3) || chr(10) ||
(SELECT 'product_category: ' || string_agg(printf('%s (%.1f%%)', key, pct), ', ' ORDER BY r) FROM t WHERE metric = 'product_category' AND r <= 3) || chr(10) || 'format: none' AS report""")
def campaign_report(spark, sf):
    return i.report(i.campaign_aggregate(ads(spark, sf), ["offer_type", "product_category"]), ["offer_type", "product_category", "format"])


@register("""WITH r AS (SELECT unnest(CASE WHEN o_custkey % 3 = 0 THEN ['UNKNOWN'] WHEN o_custkey % 3 = 1 THEN ['QA', 'AE'] ELSE ['SA'] END) AS key FROM orders)
SELECT 'region' AS metric, key, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'unknown names', '', count(*) FILTER (WHERE o_orderkey % 5 IN (0, 1)) FROM orders UNION ALL SELECT 'repeated ids', '', count(*) - count(DISTINCT o_orderkey // 2) FROM orders UNION ALL SELECT 'out of region', '', count(*) FILTER (WHERE o_custkey % 3 <> 1) FROM orders""", with_ads=False)
def ingest_check(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 3
    raw = load(spark, sf, "orders").select(F.floor(k / 2).alias("creative_id"), F.when(c == 1, "QA,AE").when(c == 2, "SA").otherwise("").alias("regions"), F.when(k % 5 == 0, "Unknown").when(k % 5 != 1, "Acme").alias("advertiser_name"))
    return i.ingest_check(raw, "QA")


@register(""", t AS (SELECT count(*) AS total, count(product_category) AS enriched FROM ads) SELECT 'total' AS metric, '' AS key, total AS n FROM t UNION ALL SELECT 'enriched', '', enriched FROM t UNION ALL SELECT 'enriched_pct', '', CAST(floor(100 * enriched / total) AS BIGINT) FROM t
UNION ALL SELECT * FROM (SELECT 'category', product_category, count(*) FROM ads WHERE product_category IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL SELECT * FROM (SELECT 'latest', ad_order || ':' || ad_line || ':' || product_name, 1 FROM ads ORDER BY first_seen_date DESC, ad_order, ad_line, product_name LIMIT 5)""")
def progress(spark, sf):
    return i.progress(ads(spark, sf))


_RUNS = "WITH r AS (SELECT CAST(ts AS DATE) AS run, event_type AS service_pair, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS slow_s, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS fast_s, bool_or(value < 0.05) AS failed FROM events GROUP BY 1, 2)"


def _runs(spark, sf):
    even = F.col("event_id") % 2 == 0
    rows = load(spark, sf, "events").groupBy(F.to_date("ts").alias("run"), F.col("event_type").alias("service_pair"))
    return rows.agg(F.avg(F.when(even, F.col("value"))).alias("slow_s"), F.avg(F.when(~even, F.col("value"))).alias("fast_s"), F.bool_or(F.col("value") < 0.05).alias("failed"))


@register(_RUNS + """, w AS (SELECT *, avg(slow_s) OVER p / avg(fast_s) OVER p AS x FROM r WINDOW p AS (PARTITION BY service_pair ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT run, service_pair, round(x, 6) AS ratio, round(least(0.7, greatest(0.3, x / (x + 1))), 6) AS share FROM w WHERE x IS NOT NULL""", with_ads=False)
def split_ratio(spark, sf):
    return i.split_ratio(_runs(spark, sf)).filter("ratio IS NOT NULL").select("run", "service_pair", F.round("ratio", 6).alias("ratio"), F.round("share", 6).alias("share"))


@register(_RUNS + " SELECT service_pair, count(*) AS runs, round(avg(slow_s), 3) AS slow_s, round(avg(fast_s), 3) AS fast_s, count(*) FILTER (WHERE failed) AS failures, round(avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END), 3) AS failure_rate FROM r GROUP BY 1", with_ads=False)
def latency_profile(spark, sf):
    return i.latency_profile(_runs(spark, sf))


# --- whole runs and queues


def _short_labels(rows):
    return rows.select("advertiser_id", F.md5("ad_text").alias("h"), labels.offers(F.col("ad_text"))[0]["type"].alias("offer_type"))


_RUN = """WITH old AS (SELECT DISTINCT source AS advertiser_id, text AS ad_text, lang AS image_url FROM documents WHERE doc_id % 3 <> 0), scraped AS (SELECT DISTINCT source AS advertiser_id, text AS ad_text, lang AS image_url FROM documents WHERE doc_id % 7 <> 0 AND source <> 'src1'),
f AS (SELECT s.* FROM scraped s WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.advertiser_id = s.advertiser_id AND o.ad_text = s.ad_text AND o.image_url = s.image_url))"""


#: What offers are called, once more, as patterns over lower-case text: nothing of a text goes before these words.
_AMOUNT, _OFF, _MONEY = "[0-9]+[ \\t\\n]*", "(off|discount|خصم)", "(qar|aed|sar|[$]|ريال)[ \\t\\n]*"
_OFFER_TYPES = {
    "percentage_discount": f"{_AMOUNT}%[ \\t\\n]*{_OFF}|((^|[^a-z])save|خصم|تخفيض)[ \\t\\n]*{_AMOUNT}%",
    "fixed_discount": f"(^|[^a-z]){_MONEY}{_AMOUNT}{_OFF}|((^|[^a-z])save|خصم|تخفيض)[ \\t\\n]*{_AMOUNT}{_MONEY}",
    "free_delivery": "(^|[^a-z])(free[ \\t\\n]*delivery|no[ \\t\\n]*delivery[ \\t\\n]*fee|delivery[ \\t\\n]*on[ \\t\\n]*us)|توصيل[ \\t\\n]*مجاني",
    "bogo": "(^|[^a-z])(buy[ \\t\\n]*([0-9]+|one)[ \\t\\n]*get[ \\t\\n]*([0-9]+|one)|b([0-9]+|one)g([0-9]+|one)|bogo)",
    "first_order": "(^|[^a-z])(first[ \\t\\n]*order|new[ \\t\\n]*customer|welcome[ \\t\\n]*offer)|عملاء[ \\t\\n]*جدد",
    "new_product": "(new|launch|جديد).*(product|item|menu|منتج)|(product|item|menu|منتج).*(new|launch|جديد)",
    "special_offer": "special offer|deal|عرض",
}
_OFFER_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower(ad_text), '(?s){p}') THEN '{n}'" for n, p in _OFFER_TYPES.items()) + " ELSE 'none' END"


@register(_RUN + f" SELECT advertiser_id, md5(ad_text) AS h, {_OFFER_TYPE} AS offer_type FROM f", with_ads=False)
def incremental_labels(spark, sf):
    """What a run labels: new ads alone."""
    old, scraped = _snapshots(spark, sf)
    _, found, _ = tracking.incremental_run(scraped, old, _short_labels, "2024-02-01")
    return found.select("advertiser_id", "h", "offer_type")


@register(f"SELECT doc_id, {_OFFER_TYPE} AS offer_type FROM (SELECT doc_id, coalesce(text, '') AS ad_text FROM documents)", with_ads=False)
def offer_types_of_documents(spark, sf):
    return load(spark, sf, "documents").select("doc_id", labels.offers(F.col("text"))[0]["type"].alias("offer_type"))


@register(_RUN + " SELECT advertiser_id, count(*) AS ads_new, CASE WHEN advertiser_id IN (SELECT advertiser_id FROM old) THEN 'update' ELSE 'first' END AS kind FROM f GROUP BY 1", with_ads=False)
def incremental_record(spark, sf):
    old, scraped = _snapshots(spark, sf)
    _, _, record = tracking.incremental_run(scraped, old, _short_labels, "2024-02-01")
    return record.filter("ads_new > 0").select("advertiser_id", "ads_new", "kind")


def _lengths(batches):
    for batch in batches:
        yield batch.assign(embedding=[[float(len(d))] for d in batch["document"]])


@register("""WITH p AS (SELECT p_name, min(p_type) AS product_type FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), s AS (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0)
SELECT p_name AS id, CAST(length(p_name || ' is a ' || product_type || ' product in the category General.') AS DOUBLE) AS size FROM p UNION ALL SELECT p_name, CAST(0 AS DOUBLE) FROM s WHERE p_name NOT IN (SELECT p_name FROM p)""", with_ads=False)
def pending_index(spark, sf):
    """The queue as JSON files, read into documents, embedded, and upserted into the index by id."""
    part, queue = load(spark, sf, "part"), scratch(spark, "queue")
    items = part.filter("p_partkey % 3 <> 0").groupBy(F.col("p_name").alias("product_name")).agg(F.min("p_type").alias("product_type")).withColumn("category", F.lit("General"))
    items.write.json(queue)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(queue)
    stored = part.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("id"), F.lit("old").alias("document"), F.lit("{}").alias("metadata"), F.array(F.lit(0.0)).alias("embedding")).distinct()
    embed = lambda docs: docs.mapInPandas(_lengths, "id string, document string, metadata string, embedding array<double>")
    found = knowledge.index(stored, knowledge.pending_documents(spark, queue), embed)
    return found.select("id", F.col("embedding")[0].alias("size"))


@register("""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, CAST(rank AS INTEGER) AS rank, r.vec_id, 'item ' || r.vec_id AS document, e.label FROM r JOIN embeddings e ON e.vec_id = r.vec_id WHERE rank <= 2""", with_ads=False)
def knn_documents(spark, sf):
    vectors = load(spark, sf, "embeddings")
    items = vectors.select("vec_id", F.concat(F.lit("item "), "vec_id").alias("document"), "label")
    return knowledge.carried(knowledge.search(vectors.filter("vec_id % 50 = 0"), vectors, 2, "l2"), items).select("query_id", "rank", "vec_id", "document", "label")


@register("SELECT ad_id, CASE WHEN k = 7 THEN 'grocery' WHEN k = 14 THEN 'pharmacy' ELSE 'restaurant' END AS product_type, CASE WHEN k = 7 THEN 'knowledge' ELSE 'rules' END AS source, CAST(CASE k WHEN 7 THEN 0.9 WHEN 14 THEN 0.85 ELSE 0.4 END AS DOUBLE) AS confidence FROM texts", with_texts=True)
def knowledge_gate(spark, sf):
    rows = texts(spark, sf).withColumn("t", labels.product_type(F.col("ad_text"), F.lit(None).cast("string"), F.lit(0.0)))
    rows = rows.select("ad_id", F.when(F.col("k") == 7, "golden spoon KITCHEN").when(F.col("k") == 8, "weak").when(F.col("k") == 14, "Golden Spoon Kitchen").alias("brand"), F.col("t.type").alias("product_type"), F.col("t.confidence").alias("confidence"))
    known = spark.createDataFrame([("Golden Spoon Kitchen", "grocery", 0.9), ("Weak", "toys", 0.5)], labels.NO_KNOWLEDGE)
    return knowledge.gate(rows, known).select("ad_id", "product_type", "source", "confidence")


# --- streams

@register("""WITH c AS (SELECT event_type, CAST(d AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY 1, 2)
SELECT c.event_type, c.start, c.n, b.n AS before, round(100.0 * (c.n - b.n) / b.n, 0) AS change_pct, CASE WHEN b.n IS NULL THEN 'new' WHEN c.n > b.n THEN 'up' WHEN c.n < b.n THEN 'down' ELSE 'stable' END AS trend FROM c LEFT JOIN c b ON b.event_type = c.event_type AND b.start = c.start - INTERVAL 7 DAY""", with_ads=False)
def stream_compared(spark, sf):
    counts = jobs.drained(jobs.trend(jobs.events_stream(spark, sf, "events.parquet"), "event_type"), "compared", "complete")
    return jobs.compared(counts, "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("WITH s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1) SELECT user_id, last_seen, last_seen >= (SELECT max(last_seen) FROM s) - INTERVAL 6 HOUR AS is_active FROM s", with_ads=False)
def stream_retired(spark, sf):
    states = jobs.drained(jobs.state(jobs.events_stream(spark, sf, "events.parquet"), "user_id"), "retired", "complete")
    return jobs.retired(states, "user_id", "6 hours").select("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "is_active")


@register("SELECT event_type, count(*) AS n FROM events GROUP BY 1", with_ads=False)
def stream_progress(spark, sf):
    return jobs.drained(jobs.progress(jobs.events_stream(spark, sf, "events.parquet"), "event_type"), "progress", "complete")


@register("""WITH e AS (SELECT *, event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-29' AS late FROM events), w AS (SELECT max(ts) - INTERVAL 5 DAY AS mark FROM e WHERE NOT late)
SELECT date_trunc('day', ts) AS start, count(*) AS n FROM e, w WHERE NOT late OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1""", with_ads=False)
def stream_late(spark, sf):
    """Events that come late: those of days that the watermark has passed are dropped, others count."""
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < F.lit("2024-01-29").cast("timestamp_ntz"))
    return jobs.days_with_late_events(load(spark, sf, "events"), late, "5 days").withColumn("start", F.col("start").cast("timestamp_ntz"))
