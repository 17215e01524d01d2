"""Grouped answers about a market: shares, top lists, timelines, coverage.

``ads`` is the joined table of ads and labels.  Times are explicit: every job that looks back takes ``as_of``.  Ties go
to the smallest key.  Shares are doubles rounded to one decimal, unless a job says that it truncates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import size_bucket

WINDOW_DAYS = {"week": 7, "7d": 7, "month": 30, "30d": 30, "quarter": 90, "90d": 90}


def valid(ads: DataFrame) -> DataFrame:
    """Active and not rejected for its region."""
    return ads.filter(F.col("is_active") & ~F.coalesce("rejected_wrong_region", F.lit(False)))


def since(time_range: str, as_of: str, column: str = "first_seen_date") -> Column:
    """Whether a time is within a named range before as_of; any other name means all times."""
    days = WINDOW_DAYS.get(time_range)
    return F.lit(True) if days is None else F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part.cast("double") / whole.cast("double"), 1)


def shared(found: DataFrame, column: str, name: str) -> DataFrame:
    """found with the percent that each row has of a column's sum, which is summed up first and sent as one row."""
    total = found.agg(F.sum(column).alias("_total"))
    return found.crossJoin(F.broadcast(total)).withColumn(name, percent(F.col(column), F.col("_total"))).drop("_total")


def title(column: str) -> Column:
    return F.initcap(F.translate(column, "_", " "))


def share_breakdown(ads: DataFrame, dim: str, collect: dict[str, str], known: Column | None = None) -> DataFrame:
    """Per value of dim: count, percent of all, and sorted distinct values of other columns joined by '|'.

    Rows are first reduced to distinct combinations, so sets are made of few rows however many ads there are.
    """
    rows = ads.filter(F.col(dim).isNotNull() if known is None else known)
    small = rows.groupBy(dim, *collect.values()).agg(F.count("*").alias("n"))
    sets = [F.array_join(F.array_sort(F.collect_set(column)), "|").alias(name) for name, column in collect.items()]
    return shared(small.groupBy(dim).agg(F.sum("n").alias("ad_count"), *sets), "ad_count", "percentage")


def offers_breakdown(ads: DataFrame) -> DataFrame:
    """Offer types by share, their advertisers and up to three details, from one pass over the ads."""
    small = valid(ads).filter("offer_type IS NOT NULL").groupBy("offer_type", "advertiser_id", "offer_details").agg(F.count("*").alias("n"))
    found = small.groupBy("offer_type").agg(F.sum("n").alias("ad_count"), F.array_join(F.array_sort(F.collect_set("advertiser_id")), "|").alias("advertisers"), F.array_join(F.slice(F.array_sort(F.collect_set("offer_details")), 1, 3), "|").alias("samples"))
    return shared(found, "ad_count", "percentage").withColumn("label", title("offer_type"))


def product_focus(ads: DataFrame, as_of: str) -> DataFrame:
    """Per advertiser and category: ads, distinct images, whole days since the first one, at least 1."""
    rows = valid(ads)
    images = rows.groupBy("advertiser_id", "product_category", "image_url").agg(F.count("*").alias("n"), F.min("first_seen_date").alias("first"))
    found = images.groupBy("advertiser_id", "product_category").agg(F.sum("n").alias("ad_count"), F.count("image_url").alias("unique_images"), F.min("first").alias("first"))
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))
    return found.withColumn("days_active", F.greatest(F.floor(seconds / 86400), F.lit(1))).drop("first")


def products_with_names(ads: DataFrame, skipped: str) -> DataFrame:
    """Category rows without one category (null kept), and rows of product names of that category."""
    counts = valid(ads).groupBy("advertiser_id", "product_category").agg(F.count("*").alias("ad_count")).filter(~F.col("product_category").eqNullSafe(F.lit(skipped)))
    named = valid(ads).filter(F.col("product_category") == skipped).groupBy("advertiser_id", "product_name").agg(F.count("*").alias("ad_count"))
    return counts.unionByName(named, allowMissingColumns=True)


def theme_share(ads: DataFrame, themes: list[str], time_range: str = "all", as_of: str = "2001-12-01") -> DataFrame:
    """Per advertiser and theme, defaults filled with 0: count and truncated percent of the advertiser's ads."""
    rows = valid(ads).filter(since(time_range, as_of))
    counts = rows.groupBy("advertiser_id", F.col("primary_theme").alias("theme")).agg(F.count("*").alias("n"))
    wanted = rows.select("advertiser_id").distinct().select("advertiser_id", F.explode(F.array(*map(F.lit, themes))).alias("theme"))
    grid = counts.select("advertiser_id", "theme").unionByName(wanted).distinct()
    same = (F.col("g.advertiser_id") == F.col("c.advertiser_id")) & F.col("g.theme").eqNullSafe(F.col("c.theme"))
    joined = grid.alias("g").join(counts.alias("c"), same, "left").select("g.advertiser_id", "g.theme", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("advertiser_id"))
    return joined.withColumn("pct", (F.col("n").cast("double") / total * 100).cast("int"))


def theme_rollup(shares: DataFrame) -> DataFrame:
    """Per theme: sum of percents over advertisers, share of all, advertisers with any."""
    rows = shares.groupBy("theme").agg(F.sum("pct").alias("total_pct"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("pct") > 0, F.col("advertiser_id")))), "|").alias("advertisers"))
    return shared(rows, "total_pct", "share").filter("theme IS NOT NULL")


def daily_counts(events: DataFrame, key: str, days: int, as_of: str, ts: str = "ts") -> DataFrame:
    """Counts by day and key and by day (key null), over the days before as_of, with a band of activity by day."""
    rows = events.filter(F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")).withColumn("day", F.to_date(ts))
    found = rows.groupingSets([["day", key], ["day"]], "day", key).agg(F.count("*").alias("n"), F.grouping(key).alias("is_total"))
    band = F.when(F.col("n") <= 5, "low").when(F.col("n") <= 15, "moderate").otherwise("high")
    return found.select("day", F.col(key).alias("key"), "n", F.col("is_total").cast("int").alias("is_total"), F.when(F.col("is_total") == 1, band).alias("band"))


def velocity_summary(daily: DataFrame) -> DataFrame:
    """Per key: active days and mean a day."""
    return daily.filter("is_total = 0").groupBy("key").agg(F.count("*").alias("active_days"), F.sum("n").alias("total"), F.round(F.avg("n"), 2).alias("mean_per_day"))


def top_names(ads: DataFrame, k: int = 20) -> DataFrame:
    """The k most advertised (name, category, advertiser); percents are of those k rows."""
    rows = valid(ads).filter("product_name IS NOT NULL AND product_name NOT IN ('', 'Unknown')")
    found = rows.groupBy("product_name", "product_category", "advertiser_id").agg(F.count("*").alias("ad_count")).orderBy(F.desc("ad_count"), "product_name", "product_category", "advertiser_id").limit(k)
    return found.select(F.substring_index("product_name", " - ", 1).alias("name"), "product_name", "product_category", "advertiser_id", "ad_count", percent(F.col("ad_count"), F.sum("ad_count").over(Window.partitionBy())).alias("percentage"))


def store_stats(ads: DataFrame) -> DataFrame:
    named = F.col("product_category").isNotNull()
    return ads.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.countDistinct("advertiser_id").alias("advertisers"), F.count_if(named).alias("enriched"), F.floor(100 * F.count_if(named) / F.count("*")).cast("int").alias("enriched_pct"))


def market_share(ads: DataFrame) -> DataFrame:
    found = ads.groupBy("advertiser_id").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))
    return shared(found, "total", "market_pct")


def competitor_list(ads: DataFrame, names: DataFrame, files: DataFrame) -> DataFrame:
    """Known advertisers with their count and latest time; of store and files the newer source counts."""
    kept = ads.filter(~F.coalesce("rejected_wrong_region", F.lit(False)))
    store = kept.groupBy("advertiser_id").agg(F.count("*").alias("ads"), F.max("first_seen_date").alias("latest")).withColumn("source", F.lit("store"))
    both = store.unionByName(files.select("advertiser_id", "ads", "latest").withColumn("source", F.lit("file")))
    best = both.groupBy("advertiser_id").agg(F.max_by(F.struct("ads", "latest", "source"), F.struct("latest", "source")).alias("x"))
    return best.join(names, "advertiser_id").select("advertiser_id", "name", "x.ads", "x.latest", "x.source")


def coverage_gaps(ads: DataFrame, dims: tuple[str, str] = ("advertiser_id", "product_name")) -> DataFrame:
    """Per advertiser: how many of the market's categories it has and lacks."""
    who, what = dims
    present = valid(ads).filter(F.col(what).isNotNull()).select(who, what).distinct()
    market = present.select(what).distinct().agg(F.count("*").alias("market"))
    return present.groupBy(who).agg(F.count("*").alias("present")).crossJoin(F.broadcast(market)).withColumn("missing", F.col("market") - F.col("present"))


def missing_pairs(ads: DataFrame, who: str, what: str) -> DataFrame:
    """The pairs of the two columns' values that no ad has.  The grid is of distinct values alone."""
    present = valid(ads).select(who, what).distinct()
    return present.select(who).distinct().crossJoin(present.select(what).distinct()).join(present, [who, what], "left_anti")


def keyword_top(docs: DataFrame, k: int = 20, least: int = 3, text: str = "text") -> DataFrame:
    """The k commonest words longer than two letters."""
    words = docs.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("keyword")).filter(F.length("keyword") >= least)
    return words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


def keyword_compare(docs: DataFrame, who: str = "source", text: str = "text") -> DataFrame:
    """Per keyword: by how many it is used, and by whom if by one alone; 'common' if by all."""
    pairs = docs.select(who, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z]+"))).alias("keyword")).filter("length(keyword) > 2").distinct()
    everyone = docs.select(who).distinct().agg(F.count("*").alias("everyone"))
    found = pairs.groupBy("keyword").agg(F.count("*").alias("users"), F.min(who).alias("first")).crossJoin(F.broadcast(everyone))
    kind = F.when(F.col("users") == F.col("everyone"), "common").when(F.col("users") == 1, "unique").otherwise("shared")
    return found.select("keyword", "users", kind.alias("kind"), F.when(F.col("users") == 1, F.col("first")).alias("only_user"))


def campaign_aggregate(rows: DataFrame, dims: list[str]) -> DataFrame:
    """One long table (metric, key, n, pct) of several columns' values, without 'N/A', percents of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("metric"), F.col(d).cast("string").alias("key")) for d in dims])).alias("x")).select("x.*").filter("key IS NOT NULL AND key <> 'N/A'")
    found = long.groupBy("metric", "key").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return found.select("metric", "key", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def campaign_terms(rows: DataFrame, lists: dict[str, str], k: int = 20) -> DataFrame:
    """(metric, key, n, kinds): the k commonest values of array columns (lower-cased, trimmed, longer than two letters) and
    how many different ones each has."""
    each = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(column).alias("values")) for name, column in lists.items()])
    terms = rows.select(F.explode(each).alias("x")).select("x.metric", F.explode("x.values").alias("raw")).filter(F.length("raw") > 2)
    counts = terms.groupBy("metric", F.trim(F.lower("raw")).alias("key")).agg(F.count("*").alias("n"))
    kinds = counts.groupBy("metric").agg(F.count("*").alias("kinds"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("n"), "key"))).filter(F.col("r") <= k)
    return top.join(F.broadcast(kinds), "metric").select("metric", "key", "n", "kinds")


def one_liner(aggregate: DataFrame, metric: str, k: int = 3) -> DataFrame:
    """The top k of a metric in a sentence."""
    top = aggregate.filter(F.col("metric") == metric).orderBy(F.desc("n"), "key").limit(k)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "key", "pct")))
    return top.agg(F.format_string("Top %s: %s", F.lit(metric), F.array_join(F.transform(listed, lambda x: F.format_string("%s (%.1f%%)", x["key"], x["pct"])), ", ")).alias("summary"))


def report(aggregate: DataFrame, metrics: list[str], k: int = 3) -> DataFrame:
    """One row of text: a line a metric with its top k, 'none' where it has no value."""
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("n"), "key"))
    top = aggregate.withColumn("r", rank).filter(F.col("r") <= k)
    line = lambda m: F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("metric") == m, F.struct("r", "key", "pct")))), lambda x: F.format_string("%s (%.1f%%)", x["key"], x["pct"])), ", "), F.lit("")), F.lit("none"))
    return top.agg(F.concat_ws("\n", *[F.concat(F.lit(f"{m}: "), line(m)) for m in metrics]).alias("report"))


def audience_flow(ads: DataFrame) -> DataFrame:
    """Volumes advertiser -> segment -> category with node totals, as a cube."""
    return valid(ads).cube("advertiser_id", "audience_segment", "product_category").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def segment_gaps(ads: DataFrame, most: int, what: str = "product_category") -> DataFrame:
    """(segment, category) pairs that at most so many advertisers address, those of none included."""
    counts = valid(ads).select("audience_segment", what, "advertiser_id").distinct().groupBy("audience_segment", what).agg(F.count("*").alias("advertisers"))
    grid = counts.select("audience_segment").distinct().crossJoin(counts.select(what).distinct())  # distinct values alone, which the result lists
    none = grid.join(counts, ["audience_segment", what], "left_anti").withColumn("advertisers", F.lit(0).cast("long"))
    return counts.unionByName(none).filter(F.col("advertisers") <= most)


def visual_profile(ads: DataFrame, as_of: str, emotion: str = "audience_segment") -> DataFrame:
    """Per advertiser: ads, with image, recent week, share with details, top category, theme and emotion, the counts of
    all categories ('name:count', by name) and three sample names."""
    week = F.col("first_seen_date") >= F.date_sub(F.lit(as_of).cast("date"), 7).cast("timestamp_ntz")
    dims = ("product_category", "primary_theme", emotion)
    small = valid(ads).groupBy("advertiser_id", *dims).agg(F.count("*").alias("n"), F.count_if(F.coalesce("image_url", F.lit("")) != "").alias("with_image"), F.count_if(week).alias("recent"), F.count("offer_details").alias("texts"), F.min("product_name").alias("sample"))
    base = small.groupBy("advertiser_id").agg(F.sum("n").alias("total"), F.sum("with_image").alias("with_image"), F.sum("recent").alias("recent"), percent(F.sum("texts"), F.sum("n")).alias("text_pct"), F.array_join(F.slice(F.array_sort(F.collect_set("sample")), 1, 3), "|").alias("samples"))
    for column in dims:
        counts = small.groupBy("advertiser_id", column).agg(F.sum("n").alias("n"))
        best = F.min_by(column, F.struct(-F.col("n"), column)).alias(f"top_{column}")
        listed = [F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", column, "n"))), "|").alias("categories")] if column == dims[0] else []
        base = base.join(counts.groupBy("advertiser_id").agg(best, *listed), "advertiser_id")
    return base


def visual_rollup(profiles: DataFrame, emotion: str = "audience_segment") -> DataFrame:
    """(metric, key, n) over all advertisers: ads by category; how many advertisers lead with a theme, and an emotion."""
    each = profiles.select(F.explode(F.split("categories", r"\|")).alias("x")).select(F.lit("category").alias("metric"), F.regexp_extract("x", "^(.*):", 1).alias("key"), F.regexp_extract("x", ":(\\d+)$", 1).cast("long").alias("n"))
    led = profiles.select(F.explode(F.array(F.struct(F.lit("theme").alias("metric"), F.col("top_primary_theme").alias("key")), F.struct(F.lit("emotion").alias("metric"), F.col(f"top_{emotion}").alias("key")))).alias("x")).select("x.*", F.lit(1).cast("long").alias("n"))
    return each.unionByName(led).groupBy("metric", "key").agg(F.sum("n").alias("n"))


def format_histogram(rows: DataFrame, html: str = "html_content") -> DataFrame:
    """How many ads there are of each named size, by the html's dimensions."""
    return rows.groupBy(size_bucket(F.col(html)).alias("bucket")).agg(F.count("*").alias("n"))


def coverage_buckets(rows: DataFrame, a: str, b: str) -> DataFrame:
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    bucket = F.when(has(a) & has(b), "both").when(has(a), f"{a} only").when(has(b), f"{b} only").otherwise("none")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def name_audit(ads: DataFrame, k: int = 40) -> DataFrame:
    found = ads.groupBy("advertiser_id", "product_name").agg(F.count("*").alias("n"))
    return found.orderBy("advertiser_id", F.desc("n"), "product_name").limit(k)


def ingest_check(raw: DataFrame, wanted: str) -> DataFrame:
    """Counts by region (missing: UNKNOWN), of unknown names, repeated ids and rows out of the wanted region."""
    regions = raw.select(F.explode_outer(F.split(F.nullif("regions", F.lit("")), ",")).alias("r")).groupBy(F.coalesce(F.trim("r"), F.lit("UNKNOWN")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("region").alias("metric"), "key", "n")
    others = raw.agg(F.count_if(F.coalesce("advertiser_name", F.lit("Unknown")) == "Unknown").alias("unknown names"), (F.count("creative_id") - F.countDistinct("creative_id")).alias("repeated ids"), F.count_if(~F.contains(F.coalesce("regions", F.lit("")), F.lit(wanted))).alias("out of region"))
    return regions.unionByName(others.unpivot([], ["unknown names", "repeated ids", "out of region"], "metric", "n").select("metric", F.lit("").alias("key"), "n"))


def acceptance(rows: DataFrame) -> DataFrame:
    """Rates of rows that a region check kept, and their mean confidence (of positive ones)."""
    return rows.agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("rejected"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 3).alias("mean_confidence"))


def split_ratio(runs: DataFrame) -> DataFrame:
    """Per run: mean times of two services over the five runs before, and the share of work for the second one."""
    w = Window.partitionBy("service_pair").orderBy("run").rowsBetween(-5, -1)
    r = F.try_divide(F.avg("slow_s").over(w), F.avg("fast_s").over(w))
    return runs.withColumn("ratio", r).withColumn("share", F.least(F.lit(0.7), F.greatest(F.lit(0.3), F.col("ratio") / (F.col("ratio") + 1))))


def latency_profile(runs: DataFrame) -> DataFrame:
    """Per pair of services: runs, mean times of either, failures and the share of runs that failed."""
    return runs.groupBy("service_pair").agg(F.count("*").alias("runs"), F.round(F.avg("slow_s"), 3).alias("slow_s"), F.round(F.avg("fast_s"), 3).alias("fast_s"), F.count_if("failed").alias("failures"), F.round(F.avg(F.col("failed").cast("double")), 3).alias("failure_rate"))


def named_like(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose name contains a text, whatever its case."""
    return rows.filter(F.contains(F.lower(column), F.lit(part.lower())))


def of_categories(rows: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """Rows whose category contains any of the texts."""
    keep = F.lit(False)
    for part in parts:
        keep = keep | F.contains(F.col(column), F.lit(part))
    return rows.filter(keep)


def progress(ads: DataFrame, k: int = 10, latest: int = 5, key: tuple[str, ...] = ("ad_order", "ad_line")) -> DataFrame:
    """(metric, key, n): all ads, labelled ones, percent, the k commonest categories and the latest ads."""
    named = F.col("product_category").isNotNull()
    totals = ads.agg(F.count("*").alias("total"), F.count_if(named).alias("enriched")).withColumn("enriched_pct", F.floor(F.try_divide(100 * F.col("enriched"), F.col("total"))))
    long = totals.unpivot([], ["total", "enriched", "enriched_pct"], "metric", "n").select("metric", F.lit("").alias("key"), "n")
    top = ads.filter(named).groupBy(F.col("product_category").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k).select(F.lit("category").alias("metric"), "key", "n")
    new = ads.orderBy(F.desc("first_seen_date"), *key, "product_name").limit(latest).select(F.lit("latest").alias("metric"), F.concat_ws(":", *key, "product_name").alias("key"), F.lit(1).cast("long").alias("n"))
    return long.unionByName(top).unionByName(new)
