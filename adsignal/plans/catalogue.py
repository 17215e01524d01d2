"""Every registered query of the advertising jobs, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gallery
from ..operators import insights as i
from ..operators import knowledge, labels, reports, tracking
from ..streaming import jobs
from .registry import ORACLES, QUERIES, register
from .views import ads, load

OWN = "NATION_1"
AS_OF = "2001-12-01"
EVENTS_AS_OF = "2024-01-31"
THEMES = ["1-URGENT", "2-HIGH", "gone"]


_SHARE = """, b AS (SELECT {dim}, count(*) AS ad_count, {sets} FROM valid WHERE {dim} IS NOT NULL GROUP BY {dim})
SELECT *, round(100.0 * ad_count / (SELECT sum(ad_count) FROM b), 1) AS percentage FROM b"""
_SET = "array_to_string(list_sort(list(DISTINCT {c})), '|') AS {name}"


def _share_sql(dim: str, **sets: str) -> str:
    return _SHARE.format(dim=dim, sets=", ".join(_SET.format(c=c, name=n) for n, c in sets.items()))


@register(""", b AS (SELECT offer_type, count(*) AS ad_count, array_to_string(list_sort(list(DISTINCT advertiser_id)), '|') AS advertisers,
  coalesce(array_to_string(list_slice(list_sort(list(DISTINCT offer_details) FILTER (WHERE offer_details IS NOT NULL)), 1, 3), '|'), '') AS samples FROM valid GROUP BY offer_type)
SELECT *, round(100.0 * ad_count / (SELECT sum(ad_count) FROM b), 1) AS percentage,
  CASE offer_type WHEN 'percentage_discount' THEN 'Percentage Discount' WHEN 'free_delivery' THEN 'Free Delivery' ELSE 'None' END AS label FROM b""")
def offers_breakdown(spark, sf):
    return i.offers_breakdown(ads(spark, sf))


@register(_share_sql("audience_segment", advertisers="advertiser_id"))
def audience_breakdown(spark, sf):
    return i.share_breakdown(i.valid(ads(spark, sf)), "audience_segment", {"advertisers": "advertiser_id"})


@register(_share_sql("brand", advertisers="advertiser_id", categories="product_category"))
def brands_breakdown(spark, sf):
    return i.share_breakdown(i.valid(ads(spark, sf)), "brand", {"advertisers": "advertiser_id", "categories": "product_category"})


@register(_share_sql("product_category", advertisers="advertiser_id", brands="brand"))
def categories_breakdown(spark, sf):
    return i.share_breakdown(i.valid(ads(spark, sf)), "product_category", {"advertisers": "advertiser_id", "brands": "brand"})


@register("""SELECT advertiser_id, product_category, count(*) AS ad_count, count(DISTINCT image_url) AS unique_images,
  greatest(CAST(floor(date_diff('second', min(first_seen_date), TIMESTAMP '2001-12-01') / 86400.0) AS BIGINT), 1) AS days_active FROM valid GROUP BY ALL""")
def product_focus(spark, sf):
    return i.product_focus(ads(spark, sf), AS_OF)


@register("""SELECT advertiser_id, product_category, count(*) AS ad_count, CAST(NULL AS VARCHAR) AS product_name FROM valid WHERE product_category IS DISTINCT FROM 'ECONOMY' GROUP BY ALL
UNION ALL SELECT advertiser_id, NULL, count(*), product_name FROM valid WHERE product_category = 'ECONOMY' GROUP BY advertiser_id, product_name""")
def products_union(spark, sf):
    return i.products_with_names(ads(spark, sf), "ECONOMY")


_THEMES_SQL = """, c AS (SELECT advertiser_id, primary_theme AS theme, count(*) AS n FROM valid GROUP BY ALL),
g AS (SELECT advertiser_id, theme FROM c UNION SELECT a.advertiser_id, t.theme FROM (SELECT DISTINCT advertiser_id FROM valid) a, (VALUES ('1-URGENT'), ('2-HIGH'), ('gone')) t(theme)),
s AS (SELECT g.advertiser_id, g.theme, coalesce(c.n, 0) AS n, CAST(trunc(CAST(coalesce(c.n, 0) AS DOUBLE) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.advertiser_id) * 100) AS INTEGER) AS pct
  FROM g LEFT JOIN c ON g.advertiser_id = c.advertiser_id AND g.theme IS NOT DISTINCT FROM c.theme)"""


@register(_THEMES_SQL + " SELECT * FROM s")
def theme_share(spark, sf):
    return i.theme_share(ads(spark, sf), THEMES)


@register(_THEMES_SQL + """, r AS (SELECT theme, CAST(sum(pct) AS BIGINT) AS total_pct, coalesce(array_to_string(list_sort(list(DISTINCT advertiser_id) FILTER (WHERE pct > 0)), '|'), '') AS advertisers FROM s GROUP BY theme)
SELECT *, round(100.0 * total_pct / (SELECT sum(total_pct) FROM r), 1) AS share FROM r WHERE theme IS NOT NULL""")
def theme_rollup(spark, sf):
    return i.theme_rollup(i.theme_share(ads(spark, sf), THEMES))


_DAILY = """WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY)
, f AS (SELECT day, event_type AS key, count(*) AS n, 0 AS is_total FROM e GROUP BY ALL UNION ALL SELECT day, NULL, count(*), 1 FROM e GROUP BY day)"""


@register(_DAILY + " SELECT *, CASE WHEN is_total = 1 THEN CASE WHEN n <= 5 THEN 'low' WHEN n <= 15 THEN 'moderate' ELSE 'high' END END AS band FROM f", with_ads=False)
def promo_timeline(spark, sf):
    return i.daily_counts(load(spark, sf, "events"), "event_type", 30, EVENTS_AS_OF)


@register(_DAILY + " SELECT key, count(*) AS active_days, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 2) AS mean_per_day FROM f WHERE is_total = 0 GROUP BY key", with_ads=False)
def velocity_daily(spark, sf):
    return i.velocity_summary(i.daily_counts(load(spark, sf, "events"), "event_type", 30, EVENTS_AS_OF))


@register(""", t AS (SELECT product_name, product_category, advertiser_id, count(*) AS ad_count FROM valid WHERE product_name NOT IN ('', 'Unknown') GROUP BY ALL ORDER BY ad_count DESC, 1, 2, 3 LIMIT 20)
SELECT split_part(product_name, ' - ', 1) AS name, *, round(100.0 * ad_count / (SELECT sum(ad_count) FROM t), 1) AS percentage FROM t""")
def top_names(spark, sf):
    return i.top_names(ads(spark, sf))


@register("SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(DISTINCT advertiser_id) AS advertisers, count(product_category) AS enriched, CAST(floor(100 * count(product_category) / count(*)) AS INTEGER) AS enriched_pct FROM ads")
def store_stats(spark, sf):
    return i.store_stats(ads(spark, sf))


@register(", m AS (SELECT advertiser_id, count(*) AS total, count(*) FILTER (WHERE is_active) AS active FROM ads GROUP BY 1) SELECT *, round(100.0 * total / (SELECT sum(total) FROM m), 1) AS market_pct FROM m")
def market_share(spark, sf):
    return i.market_share(ads(spark, sf))


@register(""", st AS (SELECT advertiser_id, count(*) AS ads, max(first_seen_date) AS latest, 'store' AS source FROM ads WHERE NOT coalesce(rejected_wrong_region, false) GROUP BY 1),
fi AS (SELECT n_name AS advertiser_id, count(*) AS ads, TIMESTAMP '2001-11-01' AS latest, 'file' AS source FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
u AS (SELECT *, row_number() OVER (PARTITION BY advertiser_id ORDER BY latest DESC, source DESC) AS r FROM (SELECT * FROM st UNION ALL SELECT * FROM fi))
SELECT u.advertiser_id, lower(u.advertiser_id) AS name, ads, latest, source FROM u JOIN nation ON n_name = u.advertiser_id WHERE r = 1""")
def competitor_list(spark, sf):
    nations = load(spark, sf, "nation")
    files = load(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("advertiser_id")).agg(F.count("*").alias("ads"), F.lit("2001-11-01").cast("timestamp_ntz").alias("latest"))
    return i.competitor_list(ads(spark, sf), nations.select(F.col("n_name").alias("advertiser_id"), F.lower("n_name").alias("name")), files)


@register(""", p AS (SELECT DISTINCT advertiser_id, product_name FROM valid) SELECT advertiser_id, count(*) AS present, any_value(m.n) AS market, any_value(m.n) - count(*) AS missing FROM p, (SELECT count(DISTINCT product_name) AS n FROM p) m GROUP BY 1""")
def coverage_gaps(spark, sf):
    return i.coverage_gaps(ads(spark, sf))


@register("""SELECT a.audience_segment, b.image_url FROM (SELECT DISTINCT audience_segment FROM valid) a, (SELECT DISTINCT image_url FROM valid) b
WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.audience_segment = a.audience_segment AND v.image_url = b.image_url)""")
def missing_pairs(spark, sf):
    return i.missing_pairs(ads(spark, sf), "audience_segment", "image_url")


@register("""SELECT CAST(first_seen_date AS DATE) AS day, count(DISTINCT advertiser_id) AS advertisers, array_to_string(list_sort(list(DISTINCT advertiser_id)), '|') AS who, count(*) AS offers
FROM ads WHERE offer_type <> 'none' AND advertiser_id <> 'NATION_1' GROUP BY 1 HAVING count(DISTINCT advertiser_id) >= 3""")
def coordinated_promos(spark, sf):
    return reports.coordinated_promos(ads(spark, sf), 3, OWN)


@register(""", c AS (SELECT product_name, advertiser_id, count(*) AS n FROM valid GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY (advertiser_id = 'NATION_1')::INT, n DESC, advertiser_id) AS r FROM c),
g AS (SELECT product_name, CAST(sum(CASE WHEN advertiser_id = 'NATION_1' THEN n ELSE 0 END) AS BIGINT) AS own, CAST(sum(CASE WHEN advertiser_id <> 'NATION_1' THEN n ELSE 0 END) AS BIGINT) AS others,
  max(CASE WHEN r = 1 AND advertiser_id <> 'NATION_1' THEN advertiser_id END) AS leader, max(CASE WHEN r = 1 AND advertiser_id <> 'NATION_1' THEN n END) AS leader_n FROM o GROUP BY 1)
SELECT *, others - own AS gap, CASE WHEN own > 0 THEN round(CAST(others AS DOUBLE) / own, 2) END AS ratio FROM g WHERE others - own > 5""")
def vulnerability(spark, sf):
    return reports.vulnerability(ads(spark, sf), OWN, "product_name")


@register("""SELECT count(*) FILTER (WHERE advertiser_id = 'NATION_1') AS own, count(*) FILTER (WHERE advertiser_id <> 'NATION_1') AS others,
coalesce(CASE WHEN count(*) FILTER (WHERE advertiser_id = 'NATION_1') > 0 THEN round(CAST(count(*) FILTER (WHERE advertiser_id <> 'NATION_1') AS DOUBLE) / count(*) FILTER (WHERE advertiser_id = 'NATION_1'), 2) END, 0) AS ratio
FROM ads WHERE first_seen_date >= TIMESTAMP '1998-06-01' AND first_seen_date < TIMESTAMP '1998-06-02'""")
def day_blitz(spark, sf):
    return reports.day_blitz(ads(spark, sf), OWN, "1998-06-01")


@register(""", v AS (SELECT count(*) FILTER (WHERE advertiser_id = 'NATION_1') AS own, count(*) AS total, count(DISTINCT CASE WHEN advertiser_id <> 'NATION_1' THEN advertiser_id END) AS competitors FROM valid)
SELECT *, round(100.0 * own / total, 1) AS share, CAST(floor((total - own) / competitors) AS BIGINT) AS target, round(100.0 * floor((total - own) / competitors) / (total - own + floor((total - own) / competitors)), 1) AS new_share FROM v""")
def visibility_whatif(spark, sf):
    return reports.visibility_what_if(ads(spark, sf), OWN)


_MONTHS = ", m AS (SELECT advertiser_id, product_category, CAST(date_trunc('month', first_seen_date) AS DATE) AS month, count(*) AS n FROM ads GROUP BY ALL)"


@register(_MONTHS + """, l AS (SELECT *, lag(n) OVER (PARTITION BY advertiser_id, product_category ORDER BY month) AS before FROM m)
SELECT *, CAST(trunc(100 * (n - before) / before) AS INTEGER) AS change_pct FROM l WHERE before IS NOT NULL AND trunc(100 * (n - before) / before) >= 200""")
def surge_mom(spark, sf):
    return reports.surges(reports.monthly(ads(spark, sf), "advertiser_id", "product_category"), ("advertiser_id", "product_category"))


@register(_MONTHS + """, s AS (SELECT advertiser_id, month, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY advertiser_id ORDER BY month) AS before FROM s)
, f AS (SELECT advertiser_id, round(avg(100.0 * (n - before) / before), 1) AS mean_change, max(month) AS month, arg_max(n, month) AS latest, arg_max(before, month) AS previous, count(*) AS months FROM l GROUP BY 1)
SELECT *, mean_change > 30 AS alert FROM f WHERE months >= 2""")
def velocity_mom(spark, sf):
    return reports.launch_velocity(reports.monthly(ads(spark, sf), "advertiser_id", "product_category"), "advertiser_id")


@register("""SELECT advertiser_id, product_name, min(first_seen_date) AS first_seen, count(*) AS total, arg_min(primary_theme, (first_seen_date, primary_theme)) AS theme
FROM ads GROUP BY 1, 2 ORDER BY first_seen DESC, 1, 2 LIMIT 10""")
def category_entry(spark, sf):
    return reports.category_entries(ads(spark, sf))


@register("SELECT advertiser_id, product_category, CAST(first_seen_date AS DATE) AS day, count(*) AS same_day, arg_max(product_name, (first_seen_date, product_name)) AS latest_name FROM ads GROUP BY 1, 2, 3")
def window_count(spark, sf):
    return reports.day_counts(ads(spark, sf))


@register(""", c AS (SELECT advertiser_id, CAST(date_trunc('quarter', first_seen_date) AS DATE) AS period, primary_theme AS theme, count(*) AS n FROM ads GROUP BY ALL),
s AS (SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY advertiser_id, period), 1) AS share FROM c)
SELECT *, round(share - lag(share) OVER (PARTITION BY advertiser_id, theme ORDER BY period), 1) AS shift FROM s""")
def theme_shift(spark, sf):
    return reports.theme_shift(ads(spark, sf))


@register("""WITH c AS (SELECT event_type, user_id % 7 AS what, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS week, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01') AS month FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY month DESC, what) AS r FROM c),
f AS (SELECT event_type, CAST(sum(week) AS BIGINT) AS week, CAST(sum(before) AS BIGINT) AS before, sum(month) AS month, max(CASE WHEN r = 1 THEN what END) AS top, max(CASE WHEN r = 1 THEN month END) AS top_n FROM r GROUP BY 1)
SELECT event_type, week, before, CASE WHEN week > before THEN 'up' WHEN week < before THEN 'down' ELSE 'stable' END AS trend, CASE WHEN before > 0 THEN round(abs(100.0 * (week - before) / before), 0) END AS change_pct,
round(100.0 * month / (SELECT sum(month) FROM f), 1) AS share_of_voice, round(month / 30.0, 2) AS velocity, top, coalesce(round(100.0 * top_n / nullif(month, 0), 1), 0) AS top_pct FROM f""", with_ads=False)
def trend_sov(spark, sf):
    return reports.trends(load(spark, sf, "events").withColumn("what", F.col("user_id") % 7), EVENTS_AS_OF, "event_type", "what")


MODULES = {"products": "product_category", "promos": "offer_type", "messaging": "primary_theme", "brands": "brand", "audience": "audience_segment", "names": "product_name"}


@register(", u AS (" + " UNION ALL ".join(f"SELECT advertiser_id, '{m}' AS module, {c} AS key FROM valid" for m, c in MODULES.items()) + """),
c AS (SELECT module, advertiser_id, key, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY module, advertiser_id ORDER BY n DESC, key) AS r FROM c), m AS (SELECT module, count(DISTINCT key) AS market FROM c GROUP BY 1)
SELECT module, advertiser_id, count(*) AS keys, CAST(sum(n) AS BIGINT) AS total, max(CASE WHEN r = 1 THEN key END) AS top, max(CASE WHEN r = 1 THEN n END) AS top_n, round(100.0 * max(CASE WHEN r = 1 THEN n END) / sum(n), 1) AS top_pct, round(100.0 * count(*) / any_value(market), 1) AS coverage_pct FROM r JOIN m USING (module) GROUP BY 1, 2""")
def module_profile(spark, sf):
    return reports.module_profile(ads(spark, sf), MODULES)


@register(""", c AS (SELECT advertiser_id, count(*) AS n FROM valid GROUP BY 1), o AS (SELECT coalesce(CAST(sum(n) AS BIGINT), 0) AS own FROM c WHERE advertiser_id = 'NATION_1')
SELECT advertiser_id AS competitor, n, own, round(CAST(n AS DOUBLE) / greatest(own, 1), 2) AS ratio, CASE WHEN n > own THEN 'behind' ELSE 'ahead' END AS verdict FROM c, o WHERE advertiser_id <> 'NATION_1' ORDER BY n DESC, 1 LIMIT 1""")
def quick_actions(spark, sf):
    return reports.quick_actions(ads(spark, sf), OWN)


@register(""", c AS (SELECT advertiser_id, count(*) AS n FROM valid GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, advertiser_id) AS r, count(*) OVER () AS last FROM c),
f AS (SELECT max(CASE WHEN r = 1 THEN advertiser_id END) AS leader, max(CASE WHEN r = 1 THEN n END) AS leader_n, max(CASE WHEN r = 2 THEN advertiser_id END) AS second, max(CASE WHEN r = 2 THEN n END) AS second_n,
 max(CASE WHEN r = last THEN advertiser_id END) AS weakest, max(CASE WHEN r = last THEN n END) AS weakest_n, CAST(sum(n) AS BIGINT) AS total, count(*) AS advertisers FROM r),
g AS (SELECT *, CAST(floor(total / advertisers) AS BIGINT) AS mean FROM f)
SELECT *, leader_n >= 2.0 * second_n AS dominant, CAST(floor(100 * leader_n / total) AS BIGINT) AS leader_pct, CASE WHEN mean > 90 THEN 'high' WHEN mean < 40 THEN 'low' ELSE 'medium' END AS intensity, leader_n - weakest_n AS gap FROM g""")
def weekly_summary(spark, sf):
    return reports.weekly_summary(ads(spark, sf))


@register("""SELECT keyword, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM documents) WHERE length(keyword) >= 3 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20""", with_ads=False)
def keyword_top(spark, sf):
    return i.keyword_top(load(spark, sf, "documents"))


@register("""WITH p AS (SELECT DISTINCT source, unnest(string_split_regex(lower(text), '[^a-z]+')) AS keyword FROM documents), e AS (SELECT count(DISTINCT source) AS n FROM documents),
k AS (SELECT keyword, count(*) AS users, min(source) AS first FROM p WHERE length(keyword) > 2 GROUP BY 1)
SELECT keyword, users, CASE WHEN users = e.n THEN 'common' WHEN users = 1 THEN 'unique' ELSE 'shared' END AS kind, CASE WHEN users = 1 THEN first END AS only_user FROM k, e""", with_ads=False)
def keyword_compare(spark, sf):
    return i.keyword_compare(load(spark, sf, "documents"))


_CAMPAIGN = """, l AS (SELECT 'offer_type' AS metric, offer_type AS key FROM ads UNION ALL SELECT 'product_category', product_category FROM ads UNION ALL SELECT 'offer_details', offer_details FROM ads),
g AS (SELECT metric, key, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ads), 1) AS pct FROM l WHERE key IS NOT NULL AND key <> 'N/A' GROUP BY 1, 2)"""


@register(_CAMPAIGN + " SELECT * FROM g")
def campaign_aggregate(spark, sf):
    return i.campaign_aggregate(ads(spark, sf), ["offer_type", "product_category", "offer_details"])


@register(_CAMPAIGN + """ SELECT 'Top offer_type: ' || string_agg(printf('%s (%.1f%%)', key, pct), ', ' ORDER BY n DESC, key) AS summary FROM (SELECT * FROM g WHERE metric = 'offer_type' ORDER BY n DESC, key LIMIT 3)""")
def campaign_one_liner(spark, sf):
    return i.one_liner(i.campaign_aggregate(ads(spark, sf), ["offer_type", "product_category", "offer_details"]), "offer_type")


@register("SELECT advertiser_id, audience_segment, product_category, count(*) AS n, CAST(grouping(advertiser_id, audience_segment, product_category) AS INTEGER) AS level FROM valid GROUP BY CUBE (advertiser_id, audience_segment, product_category)")
def audience_flow_cube(spark, sf):
    return i.audience_flow(ads(spark, sf))


@register(""", c AS (SELECT audience_segment, image_url, count(DISTINCT advertiser_id) AS advertisers FROM valid GROUP BY 1, 2),
g AS (SELECT s.audience_segment, p.image_url, coalesce(c.advertisers, 0) AS advertisers FROM (SELECT DISTINCT audience_segment FROM valid) s CROSS JOIN (SELECT DISTINCT image_url FROM valid) p LEFT JOIN c ON c.audience_segment = s.audience_segment AND c.image_url = p.image_url)
SELECT * FROM g WHERE advertisers <= 1""")
def segment_gaps(spark, sf):
    return i.segment_gaps(ads(spark, sf), 1, "image_url")


_VISUAL = """, c AS (SELECT advertiser_id, product_category, count(*) AS n FROM valid GROUP BY 1, 2), t AS (SELECT advertiser_id, primary_theme, count(*) AS n FROM valid GROUP BY 1, 2), e AS (SELECT advertiser_id, audience_segment, count(*) AS n FROM valid GROUP BY 1, 2),
g AS (SELECT advertiser_id, product_category, primary_theme, audience_segment, min(product_name) AS sample FROM valid GROUP BY ALL), s AS (SELECT advertiser_id, array_to_string(list_slice(list_sort(list(DISTINCT sample)), 1, 3), '|') AS samples FROM g GROUP BY 1),
f AS (SELECT v.advertiser_id, count(*) AS total, count(*) FILTER (WHERE image_url <> '') AS with_image, count(*) FILTER (WHERE first_seen_date >= TIMESTAMP '2001-10-25') AS recent, round(100.0 * count(offer_details) / count(*), 1) AS text_pct FROM valid v GROUP BY 1),
p AS (SELECT f.*, s.samples, (SELECT arg_min(product_category, (-n, product_category)) FROM c WHERE c.advertiser_id = f.advertiser_id) AS top_product_category, (SELECT arg_min(primary_theme, (-n, primary_theme)) FROM t WHERE t.advertiser_id = f.advertiser_id) AS top_primary_theme,
 (SELECT arg_min(audience_segment, (-n, audience_segment)) FROM e WHERE e.advertiser_id = f.advertiser_id) AS top_audience_segment, (SELECT array_to_string(list_sort(list(product_category || ':' || n)), '|') FROM c WHERE c.advertiser_id = f.advertiser_id) AS categories FROM f JOIN s ON s.advertiser_id = f.advertiser_id)"""


@register(_VISUAL + " SELECT * FROM p")
def visual_profile(spark, sf):
    return i.visual_profile(ads(spark, sf), "2001-11-01")


@register(_VISUAL + """ SELECT 'category' AS metric, product_category AS key, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 2 UNION ALL SELECT 'theme', top_primary_theme, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'emotion', top_audience_segment, count(*) FROM p GROUP BY 2""")
def visual_rollup(spark, sf):
    return i.visual_rollup(i.visual_profile(ads(spark, sf), "2001-11-01"))


@register("""SELECT CASE WHEN offer_details IS NOT NULL THEN 'both' ELSE 'brand only' END AS bucket, count(*) AS n FROM ads GROUP BY 1""")
def coverage_buckets(spark, sf):
    return i.coverage_buckets(ads(spark, sf), "brand", "offer_details")


@register("SELECT advertiser_id, product_name, count(*) AS n FROM ads GROUP BY 1, 2 ORDER BY 1, n DESC, 2 LIMIT 40")
def name_audit(spark, sf):
    return i.name_audit(ads(spark, sf))


# --- tracking: documents as ads; two snapshots share some of them

_SNAPSHOTS = """WITH old AS (SELECT source AS advertiser_id, text AS ad_text, lang AS image_url, min(TIMESTAMP '2024-01-01') AS first_seen_date, bool_or(doc_id % 5 <> 1) AS is_active FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1, 2, 3),
scraped AS (SELECT DISTINCT source AS advertiser_id, text AS ad_text, lang AS image_url FROM documents WHERE doc_id % 7 <> 0 AND source <> 'src1')"""
_SAME = "o.advertiser_id = s.advertiser_id AND o.ad_text = s.ad_text AND o.image_url = s.image_url"


def _snapshots(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.col("source").alias("advertiser_id"), F.col("text").alias("ad_text"), F.col("lang").alias("image_url"))
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    old = docs.filter("doc_id % 3 <> 0").groupBy(*tracking.KEY).agg(F.min(at).alias("first_seen_date"), F.min(at).alias("last_seen_date"), F.bool_or(F.col("doc_id") % 5 != 1).alias("is_active"))
    return old, docs.filter("doc_id % 7 <> 0 AND advertiser_id <> 'src1'").select(*tracking.KEY).distinct()


@register(_SNAPSHOTS + f" SELECT s.advertiser_id, md5(s.ad_text) AS h FROM scraped s WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {_SAME})", with_ads=False)
def new_ads(spark, sf):
    old, scraped = _snapshots(spark, sf)
    return tracking.new_ads(scraped, old).select("advertiser_id", F.md5("ad_text").alias("h"))


@register(_SNAPSHOTS + f" SELECT s.advertiser_id, md5(s.ad_text) AS h FROM scraped s WHERE EXISTS (SELECT 1 FROM old o WHERE {_SAME})", with_ads=False)
def seen_ads(spark, sf):
    old, scraped = _snapshots(spark, sf)
    return tracking.seen_ads(scraped, old).select("advertiser_id", F.md5("ad_text").alias("h"))


@register(_SNAPSHOTS + f" SELECT o.advertiser_id, md5(o.ad_text) AS h FROM old o WHERE is_active AND o.advertiser_id IN (SELECT advertiser_id FROM scraped) AND NOT EXISTS (SELECT 1 FROM scraped s WHERE {_SAME})", with_ads=False)
def retired_ads(spark, sf):
    old, scraped = _snapshots(spark, sf)
    return tracking.retired_ads(old, scraped).select("advertiser_id", F.md5("ad_text").alias("h"))


_UPSERT = _SNAPSHOTS + f""", u AS (SELECT coalesce(o.advertiser_id, s.advertiser_id) AS advertiser_id, md5(coalesce(o.ad_text, s.ad_text)) AS h, coalesce(o.first_seen_date, TIMESTAMP '2024-02-01') AS first_seen_date,
 CASE WHEN s.ad_text IS NOT NULL AND o.ad_text IS NOT NULL THEN 'updated' WHEN s.ad_text IS NOT NULL THEN 'new' WHEN o.is_active AND o.advertiser_id IN (SELECT advertiser_id FROM scraped) THEN 'retired' ELSE 'kept' END AS change, o.is_active AS was
 FROM old o FULL OUTER JOIN scraped s ON {_SAME})"""


@register(_UPSERT + " SELECT advertiser_id, h, first_seen_date, CASE WHEN change IN ('updated', 'new', 'retired') THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS last_seen_date, CASE change WHEN 'updated' THEN true WHEN 'new' THEN true WHEN 'retired' THEN false ELSE was END AS is_active, change FROM u", with_ads=False)
def upsert_merge(spark, sf):
    old, scraped = _snapshots(spark, sf)
    return tracking.upsert(old, scraped, "2024-02-01").select("advertiser_id", F.md5("ad_text").alias("h"), "first_seen_date", "last_seen_date", "is_active", "change")


@register(_UPSERT + " SELECT advertiser_id, count(*) FILTER (WHERE change = 'new') AS ads_new, count(*) FILTER (WHERE change = 'updated') AS ads_updated, count(*) FILTER (WHERE change = 'retired') AS ads_retired, count(*) FILTER (WHERE change = 'kept') AS ads_kept FROM u GROUP BY 1", with_ads=False)
def run_record(spark, sf):
    old, scraped = _snapshots(spark, sf)
    return tracking.run_record(tracking.upsert(old, scraped, "2024-02-01"))


_LABELS = "WITH l AS (SELECT o_orderkey AS ad_id, o_orderpriority AS product_category, o_orderstatus AS product_name, false AS manually_edited FROM orders WHERE o_orderkey % 4 <> 0)"


def _labels(spark, sf):
    return load(spark, sf, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("ad_id"), F.col("o_orderpriority").alias("product_category"), F.col("o_orderstatus").alias("product_name"), F.lit(False).alias("manually_edited"))


@register(_LABELS + """, e AS (SELECT o_orderkey AS ad_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Edited' END AS product_category, CASE WHEN o_orderkey % 3 = 0 THEN 'Name' END AS product_name FROM orders WHERE o_orderkey % 7 = 0)
SELECT coalesce(l.ad_id, e.ad_id) AS ad_id, coalesce(e.product_category, l.product_category) AS product_category, coalesce(e.product_name, l.product_name) AS product_name, e.ad_id IS NOT NULL AS manually_edited FROM l FULL OUTER JOIN e ON l.ad_id = e.ad_id""", with_ads=False)
def manual_edits(spark, sf):
    key = F.col("o_orderkey")
    edits = load(spark, sf, "orders").filter(key % 7 == 0).select(key.alias("ad_id"), F.when(key % 2 == 0, "Edited").alias("product_category"), F.when(key % 3 == 0, "Name").alias("product_name"))
    return tracking.manual_edits(_labels(spark, sf), edits, "ad_id")


@register(_LABELS + """ SELECT coalesce(l.ad_id, d.ad_id) AS ad_id, l.product_category, d.ad_id IS NOT NULL AS rejected_wrong_region FROM l FULL OUTER JOIN (SELECT o_orderkey AS ad_id FROM orders WHERE o_orderkey % 9 = 0) d ON l.ad_id = d.ad_id""", with_ads=False)
def soft_delete(spark, sf):
    ids = load(spark, sf, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("ad_id"))
    return tracking.soft_delete(_labels(spark, sf).withColumn("rejected_wrong_region", F.lit(False)), ids, "ad_id")


@register("SELECT doc_id, lang, md5(text) AS h FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1", with_ads=False)
def dedupe_keep_first(spark, sf):
    return tracking.keep_first(load(spark, sf, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang", F.md5("text").alias("h"))


@register("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O')::INT DESC, o_orderkey) AS r FROM orders) WHERE r <= 2", with_ads=False)
def sample_per_group(spark, sf):
    return tracking.sample_per_group(load(spark, sf, "orders"), "o_custkey", 2, F.col("o_orderstatus") == "O", "o_orderkey").select("o_orderkey", "o_custkey")


@register("SELECT DISTINCT advertiser_id, product_name FROM ads WHERE contains(lower(product_name), 'red') AND advertiser_id <> 'NATION_1'")
def contaminated_names(spark, sf):
    platforms = load(spark, sf, "nation").filter(F.col("n_name") == OWN).select(F.lit("red").alias("platform"), F.col("n_name").alias("advertiser_id"))
    return tracking.contamination(ads(spark, sf).select("advertiser_id", "product_name").distinct(), platforms)


@register("SELECT count(*) AS total, count(*) FILTER (WHERE product_name IS NULL OR (contains(lower(product_name), 'red') AND advertiser_id <> 'NATION_1')) AS cleared FROM ads")
def repaired_names(spark, sf):
    return tracking.repair(ads(spark, sf), [("red", OWN)]).agg(F.count("*").alias("total"), F.count_if(F.col("product_name").isNull()).alias("cleared"))


# --- single ads

@register("""WITH k AS (SELECT * FROM pages WHERE contains(url, '/en/')) SELECT page_id, 'https://proxy.example/?u=' || replace(url_encode(url), '%2F', '/') AS link, (SELECT count(*) FROM k) AS total FROM k WHERE page_id > 40 ORDER BY page_id LIMIT 50""", with_ads=False)
def gallery_page(spark, sf):
    page = gallery.gallery(load(spark, sf, "pages"), "page_id", 50, F.contains("url", F.lit("/en/")), F.lit(40))
    return page.select("page_id", gallery.proxy_link(F.col("url"), "https://proxy.example/?u=").alias("link"), "total")


@register("SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'missing' ELSE 'general' END AS why FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality = 0", with_ads=False)
def unlabelled_ads(spark, sf):
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left").withColumn("category", F.when(F.col("quality") == 0, "Other").otherwise(F.col("quality").cast("string")))
    return gallery.unlabelled(rows, "category").select("doc_id", "why")


@register(", c AS (SELECT seller_id, count(*) AS n FROM ads GROUP BY 1) SELECT seller_id, n, coalesce(CASE WHEN seller_id % 2 = 0 THEN s_name END, CAST(seller_id AS VARCHAR)) AS display_name FROM c JOIN supplier ON s_suppkey = seller_id")
def named_sellers(spark, sf):
    names = load(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("name"))
    return gallery.named(ads(spark, sf).groupBy("seller_id").agg(F.count("*").alias("n")), names, "seller_id")


@register(""", d AS (SELECT advertiser_id, offer_type, CAST(first_seen_date AS DATE) AS day, count(*) AS n FROM ads WHERE advertiser_id <> 'NATION_1' AND offer_type <> 'none' GROUP BY 1, 2, 3 ORDER BY day DESC, n DESC, 1, 2 LIMIT 5)
SELECT advertiser_id, offer_type, n, strftime(day, '%b %d, %Y') AS launched, strftime(day + INTERVAL 7 DAY, '%b %d, %Y') AS manual, strftime(day + INTERVAL 1 DAY, '%b %d, %Y') AS alert FROM d""")
def detection_lag(spark, sf):
    return gallery.detection_lag(ads(spark, sf), OWN)


@register("SELECT advertiser_id, min(first_seen_date) AS first_seen, max(first_seen_date) AS last_seen, count(*) AS ads FROM ads GROUP BY 1")
def campaign_range(spark, sf):
    return gallery.campaign_range(ads(spark, sf))


@register(_MONTHS + ", s AS (SELECT advertiser_id, month, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL) SELECT *, n - lag(n) OVER (PARTITION BY advertiser_id ORDER BY month) AS delta FROM s")
def run_deltas(spark, sf):
    return gallery.deltas(reports.monthly(ads(spark, sf), "advertiser_id"), "advertiser_id", "month", "n")


@register("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 5", with_ads=False)
def latest_rows(spark, sf):
    return gallery.latest(load(spark, sf, "events").select("event_id", "ts", "event_type"), "ts", "event_id")


@register("SELECT coalesce(offer_details, 'Unknown') AS value, count(*) AS n FROM ads GROUP BY 1")
def detail_distribution(spark, sf):
    return gallery.distribution(ads(spark, sf), "offer_details")


@register(_UPSERT + " SELECT CAST(count(*) FILTER (WHERE change = 'new') AS BIGINT) AS ads_new, count(*) FILTER (WHERE change = 'updated') AS ads_updated, count(*) FILTER (WHERE change = 'retired') AS ads_retired, count(DISTINCT advertiser_id) AS succeeded, CAST(0 AS BIGINT) AS failed FROM u", with_ads=False)
def run_summary(spark, sf):
    old, scraped = _snapshots(spark, sf)
    return gallery.run_summary(tracking.run_record(tracking.upsert(old, scraped, "2024-02-01")).withColumn("error", F.lit(None).cast("string")))


# --- labels on documents, with lexicons of words that occur

TERMS = ["free", "best", "license", "the", "th", "und"]
LEXICON = {"alpha": ["free", "best"], "beta": ["license", "und", "der"], "gamma": ["les", "que", "une"]}
WEIGHTED = {"A": {"the": 2.0, "free": 3.0}, "B": {"der": 3.0, "und": 1.5}, "C": {"les": 3.0, "que": 2.0}}


def _hits_sql(terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{t}')::INT" for t in terms) + ")"


@register("SELECT doc_id, array_to_string(list_filter(['" + "','".join(TERMS) + "'], lambda x: contains(lower(text), x)), '|') AS terms, " + _hits_sql(TERMS) + " AS n FROM documents", with_ads=False)
def term_hits(spark, sf):
    t = F.col("text")
    return load(spark, sf, "documents").select("doc_id", F.array_join(labels.hits(t, TERMS), "|").alias("terms"), labels.hit_count(t, TERMS).alias("n"))


@register("WITH s AS (SELECT doc_id, " + ", ".join(f"least(1.0, round({_hits_sql(t)} / 3.0, 2))::DOUBLE AS {n}" for n, t in LEXICON.items()) + " FROM documents) SELECT doc_id, alpha, beta, gamma, CASE WHEN alpha >= beta AND alpha >= gamma THEN 'alpha' WHEN beta >= gamma THEN 'beta' ELSE 'gamma' END AS primary_theme FROM s", with_ads=False)
def theme_scores(spark, sf):
    found = load(spark, sf, "documents").select("doc_id", labels.themes(F.col("text"), F.lit("none"), LEXICON, ()).alias("t"))
    return found.select("doc_id", *[F.col("t.scores")[n].alias(n) for n in LEXICON], F.col("t.primary").alias("primary_theme"))


@register("WITH s AS (SELECT doc_id, " + ", ".join("(" + " + ".join(f"(CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0 END)" for t, w in terms.items()) + f")::DOUBLE AS {n}" for n, terms in WEIGHTED.items()) + """ FROM documents),
o AS (SELECT *, list_sort([A, B, C], 'DESC') AS l FROM s)
SELECT doc_id, l[1] AS score, CASE WHEN l[1] < 3 THEN NULL WHEN l[2] >= 3 AND l[2] / l[1] >= 0.7 THEN 'Mixed' WHEN A = l[1] THEN 'A' WHEN B = l[1] THEN 'B' ELSE 'C' END AS category FROM o""", with_ads=False)
def food_scores(spark, sf):
    found = load(spark, sf, "documents").select("doc_id", labels.food(F.col("text"), F.lit(None).cast("string"), WEIGHTED).alias("f"))
    return found.select("doc_id", "f.score", "f.category")


# --- links and JSON

@register("SELECT page_id, split_part(split_part(url, '://', 2), '/', 2) AS lang, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), ''), 'QA') AS ref FROM pages", with_ads=False)
def url_param(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("lang"), tx.url_parameter(F.col("url"), "ref", "QA").alias("ref"))


@register("SELECT page_id, upper(substr(s, 1, 1)) || substr(s, 2) AS title FROM (SELECT page_id, regexp_extract(url, '([a-z]+)[.]example', 1) AS s FROM pages) WHERE length(s) > 2", with_ads=False)
def slug_title(spark, sf):
    found = load(spark, sf, "pages").select("page_id", tx.slug_title(F.regexp_extract("url", r"([a-z]+)\.example", 1)).alias("title"))
    return found.filter("title IS NOT NULL")


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", with_ads=False)
def json_props(spark, sf):
    return load(spark, sf, "events").select("event_id", tx.json_in_reply(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), "k bigint")["k"].alias("k"))


@register("""WITH q AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part UNION SELECT DISTINCT upper(p_name) FROM part WHERE p_partkey % 10 = 0),
e AS (SELECT query, min(p_name) AS product_name, 'exact' AS how FROM q JOIN part ON lower(query) = lower(p_name) GROUP BY 1),
r AS (SELECT query FROM q WHERE query NOT IN (SELECT query FROM e)),
n AS (SELECT query, arg_min(p_name, (length(p_name), p_name)) AS product_name, 'contains' AS how FROM r JOIN part ON contains(lower(p_name), lower(query)) GROUP BY 1)
SELECT * FROM e UNION ALL SELECT * FROM n""", with_ads=False)
def kb_lookup(spark, sf):
    part = load(spark, sf, "part")
    asked = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query")).union(part.filter("p_partkey % 10 = 0").select(F.upper("p_name")))
    return knowledge.lookup(asked, part.select(F.col("p_name").alias("product_name")))


@register("""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id FROM d QUALIFY rank <= 3""", with_ads=False)
def knn_topk(spark, sf):
    vectors = load(spark, sf, "embeddings")
    return knowledge.search(vectors.filter("vec_id % 50 = 0"), vectors, 3).select("query_id", "rank", "vec_id")


# --- streams over the events file; results on closed windows or complete tables

def _events(spark, sf):
    return jobs.events_stream(spark, sf, "events.parquet")


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", with_ads=False)
def stream_velocity(spark, sf):
    return jobs.drained(jobs.velocity(_events(spark, sf), "event_type"), "velocity", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("SELECT event_id, event_type FROM events", with_ads=False)
def stream_dedupe(spark, sf):
    return jobs.drained(jobs.deduplicated(_events(spark, sf)), "dedupe").select("event_id", "event_type")


@register("""SELECT event_type, CAST(d AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY 1, 2""", with_ads=False)
def stream_trend(spark, sf):
    return jobs.drained(jobs.trend(_events(spark, sf), "event_type"), "trend", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1", with_ads=False)
def stream_state(spark, sf):
    rows = jobs.drained(jobs.state(_events(spark, sf), "user_id"), "state", "complete")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@register("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, g""", with_ads=False)
def stream_sessions(spark, sf):
    rows = jobs.drained(jobs.bursts(_events(spark, sf), "user_id"), "bursts", "complete")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@register("SELECT date_trunc('day', ts) AS day, CAST(count(DISTINCT user_id) AS INTEGER) AS who, count(*) AS n FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 3", with_ads=False)
def stream_coordinated(spark, sf):
    return jobs.drained(jobs.coordinated(_events(spark, sf), "user_id"), "coordinated", "complete").withColumn("day", F.col("day").cast("timestamp_ntz"))


# The other queries register themselves.
from . import label_queries, more_queries, row_queries, source_queries, stream_queries  # noqa: E402, F401
