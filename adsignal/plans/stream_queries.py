"""Queries of streams over split input, merged stores, cubes that runs add to, and distinct counts by sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distinct, tracking
from ..sources.scratch import scratch
from ..streaming import jobs, stateful, store
from .registry import register
from .views import load

#: The last watermark of all events, in whole milliseconds, a day behind the latest one.
_MARK = "m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS mark FROM events)"


def _split(spark, sf):
    """The events in two parts that overlap by some ten hours."""
    rows = load(spark, sf, "events").withColumn("at_", F.unix_timestamp(F.col("ts").cast("timestamp")))
    first, last = rows.agg(F.min("at_"), F.max("at_")).first()
    early = F.col("at_") + F.col("event_id") % 5 * 8640 < (first or 0) + 0.6 * ((last or 0) - (first or 0))
    return [rows.filter(early).drop("at_"), rows.filter(~early).drop("at_")]


@register(f"""WITH {_MARK}, o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events, m WHERE ts <= mark WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o), p AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, g)
SELECT user_id, 'active' AS change, first_seen AS at, first_seen, first_seen AS last_seen, 1 AS n FROM p UNION ALL SELECT user_id, 'retired', last_seen + INTERVAL 12 HOUR, first_seen, last_seen, n FROM p, m WHERE last_seen + INTERVAL 12 HOUR <= mark""", with_ads=False)
def stream_lifecycle(spark, sf):
    """When each user turns active and is retired, by timers, over two runs."""
    with stateful.keyed_state(spark):
        return jobs.in_runs(_split(spark, sf), lambda events: stateful.lifecycle(events, "user_id", "12 hours", "1 day"))


@register(f"""WITH {_MARK}, c AS (SELECT event_type, CAST(d AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY 1, 2)
SELECT c.event_type, c.start, c.n, b.n AS before, round(100.0 * (c.n - b.n) / b.n, 0) + 0.0 AS change_pct, CASE WHEN b.n IS NULL THEN 'new' WHEN c.n > b.n THEN 'up' WHEN c.n < b.n THEN 'down' ELSE 'stable' END AS trend FROM c CROSS JOIN m LEFT JOIN c b ON b.event_type = c.event_type AND b.start = c.start - INTERVAL 7 DAY WHERE c.start + INTERVAL 7 DAY <= mark""", with_ads=False)
def stream_weeks(spark, sf):
    """Week against week inside the stream, over two runs."""
    with stateful.keyed_state(spark):
        return jobs.in_runs(_split(spark, sf), lambda events: stateful.weeks_compared(events, "event_type", "1 day"))


@register("SELECT event_id, event_type FROM events", with_ads=False)
def stream_repeats(spark, sf):
    """Every event once: a tenth comes twice in the first run, another tenth again in a second, most of it long after."""
    rows = load(spark, sf, "events")
    parts = [rows.unionByName(rows.filter("event_id % 10 = 0")), rows.filter("event_id % 10 = 1")]
    return jobs.in_runs(parts, jobs.deduplicated).select("event_id", "event_type")


@register("SELECT date_trunc('day', ts) AS day, count(*) AS n, true AS close FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 3", with_ads=False)
def stream_coordinated_at_size(spark, sf):
    """Days with several users, by sketches; close: within three standard errors of the exact count."""
    found = jobs.in_runs(_split(spark, sf), lambda events: jobs.coordinated_at_size(events, "user_id"), "update").groupBy("day").agg(F.max("n").alias("n"), F.max_by("who", "n").alias("who"))
    exact = load(spark, sf, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.countDistinct("user_id").alias("exact"))
    return found.join(exact, "day").select(F.col("day").cast("timestamp_ntz").alias("day"), "n", (F.abs(F.col("who") - F.col("exact")) <= F.col("exact") * distinct.error()).alias("close"))


@register("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d, event_type, user_id FROM events), w AS (SELECT unnest(generate_series(d, d + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS day, event_type, user_id FROM d)
SELECT CAST(day AS DATE) AS day, event_type, count(DISTINCT user_id) AS exact, true AS close FROM w GROUP BY 1, 2""", with_ads=False)
def distinct_in_windows(spark, sf):
    """Users of any seven days as unions of daily sketches, stored by two runs; close: within three standard errors."""
    kept = scratch(spark, "sketches")
    for part in _split(spark, sf):
        distinct.daily_sketches(part, "user_id", ["event_type"]).write.mode("append").parquet(kept)
    stored = distinct.added(spark.read.parquet(kept), spark.read.parquet(kept).limit(0), ["event_type"])
    users = load(spark, sf, "events").select(F.explode(F.expr("sequence(to_date(ts), date_add(to_date(ts), 6))")).alias("day"), "event_type", "user_id")
    exact = users.groupBy("day", "event_type").agg(F.countDistinct("user_id").alias("exact"))
    return distinct.in_windows(stored, 7, ["event_type"]).join(exact, ["day", "event_type"]).select("day", "event_type", "exact", (F.abs(F.col("who") - F.col("exact")) <= F.col("exact") * distinct.error()).alias("close"))


SNAPSHOTS = [("doc_id % 3 <> 0", "2024-01-01"), ("doc_id % 7 <> 0 AND source <> 'src1'", "2024-02-01"), ("doc_id % 5 <> 0 AND source <> 'src2'", "2024-03-01")]


def _merged_sql() -> str:
    """Each snapshot merged into what the ones before have left: u0, u1, u2."""
    out = []
    for n, (which, at) in enumerate(SNAPSHOTS):
        out.append(f"s{n} AS (SELECT DISTINCT coalesce(source, '') AS advertiser_id, coalesce(text, '') AS ad_text, coalesce(lang, '') AS image_url FROM documents WHERE source IS NOT NULL AND {which})")
        if not n:
            out.append(f"u0 AS (SELECT *, TIMESTAMP '{at}' AS first_seen_date, TIMESTAMP '{at}' AS last_seen_date, true AS is_active FROM s0)")
            continue
        gone = f"s.ad_text IS NULL AND o.is_active AND o.advertiser_id IN (SELECT advertiser_id FROM s{n})"
        out.append(f"""u{n} AS (SELECT coalesce(o.advertiser_id, s.advertiser_id) AS advertiser_id, coalesce(o.ad_text, s.ad_text) AS ad_text, coalesce(o.image_url, s.image_url) AS image_url, coalesce(o.first_seen_date, TIMESTAMP '{at}') AS first_seen_date,
 CASE WHEN s.ad_text IS NOT NULL OR {gone} THEN TIMESTAMP '{at}' ELSE o.last_seen_date END AS last_seen_date, CASE WHEN s.ad_text IS NOT NULL THEN true WHEN {gone} THEN false ELSE o.is_active END AS is_active
 FROM u{n - 1} o FULL OUTER JOIN s{n} s ON o.advertiser_id = s.advertiser_id AND o.ad_text = s.ad_text AND o.image_url = s.image_url)""")
    return "WITH " + ", ".join(out)


def _snapshots(spark, sf):
    docs = load(spark, sf, "documents").filter("source IS NOT NULL")
    return [(docs.filter(which).select(F.col("source").alias("advertiser_id"), F.col("text").alias("ad_text"), F.col("lang").alias("image_url")), at) for which, at in SNAPSHOTS]


@register(_merged_sql() + " SELECT advertiser_id, md5(ad_text) AS h, image_url, first_seen_date, last_seen_date, is_active FROM u2", with_ads=False)
def stream_merged(spark, sf):
    """Snapshots that come as files, merged into a store by advertiser; an old batch and the last come again."""
    ads, place = store.AdStore(spark, scratch(spark, "store")), scratch(spark, "snapshots")
    dates = {}

    def merge(batch, number):
        at = batch.agg(F.max("ts")).first()[0]
        if at is not None:
            dates[number] = str(at)
            ads.merge(batch, number, str(at))

    found = _snapshots(spark, sf)
    for rows, at in found:
        rows.withColumn("ts", F.lit(at).cast("timestamp_ntz")).write.mode("append").parquet(place)
        stream = jobs.events_stream(spark, place, "*.parquet", "advertiser_id string, ad_text string, image_url string, ts timestamp_ntz")
        stream.writeStream.option("checkpointLocation", f"{place}-progress").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    for again in (0, 2):
        ads.merge(found[again][0], sorted(dates)[again], found[again][1])
    return ads.rows().select("advertiser_id", F.md5("ad_text").alias("h"), "image_url", "first_seen_date", "last_seen_date", "is_active")


@register(_merged_sql() + " SELECT CAST(first_seen_date AS DATE) AS day, advertiser_id, image_url, count(*) AS ads, count(*) FILTER (WHERE is_active) AS active FROM u2 GROUP BY 1, 2, 3", with_ads=False)
def cube_of_runs(spark, sf):
    """Ads and active ads by day, advertiser and image, kept by what each run changes; a run comes twice, two are folded."""
    by = {"day": F.to_date("first_seen_date"), "advertiser_id": F.col("advertiser_id"), "image_url": F.col("image_url")}
    cube, version = store.Cube(spark, scratch(spark, "cube"), "day date, advertiser_id string, image_url string", ["ads", "active"]), spark.createDataFrame([], store.STORE)
    for number, (rows, at) in enumerate(_snapshots(spark, sf)):
        kept = scratch(spark, "version")
        tracking.upsert(version, rows, at, before=True).write.parquet(kept)
        version = spark.read.parquet(kept)
        for _ in range(1 + number % 2):
            cube.add(store.changes_of(version, by), number)
        if number == 1:
            cube.fold(1)
        version = version.drop("change", "was_active")
    return cube.rows()
