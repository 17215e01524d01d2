"""Reports that compare one company with its competitors and look for changes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .insights import percent, shared, valid


def monthly(ads: DataFrame, *keys: str) -> DataFrame:
    return ads.groupBy(*keys, F.to_date(F.date_trunc("month", "first_seen_date")).alias("month")).agg(F.count("*").alias("n"))


def surges(cube: DataFrame, keys: tuple[str, str], least_pct: int = 200) -> DataFrame:
    """Months in which a count grew by so many percent over the previous month that has any."""
    before = F.lag("n").over(Window.partitionBy(*keys).orderBy("month"))
    change = (100 * (F.col("n") - F.col("before")) / F.col("before")).cast("int")
    return cube.withColumn("before", before).filter("before IS NOT NULL").withColumn("change_pct", change).filter(F.col("change_pct") >= least_pct)


def launch_velocity(cube: DataFrame, key: str) -> DataFrame:
    """Mean change by month, the last two months' counts, and an alert above 30 percent."""
    months = cube.groupBy(key, "month").agg(F.sum("n").alias("n"))
    months = months.withColumn("before", F.lag("n").over(Window.partitionBy(key).orderBy("month"))).withColumn("change", 100.0 * (F.col("n") - F.col("before")) / F.col("before"))
    found = months.groupBy(key).agg(F.round(F.avg("change"), 1).alias("mean_change"), F.max("month").alias("month"), F.max_by("n", "month").alias("latest"), F.max_by("before", "month").alias("previous"), F.count("*").alias("months")).filter("months >= 2")
    return found.withColumn("alert", F.col("mean_change") > 30)


def category_entries(ads: DataFrame, k: int = 10) -> DataFrame:
    """The latest first appearances of an advertiser in a category, with the earliest ad's theme."""
    found = ads.groupBy("advertiser_id", "product_name").agg(F.min("first_seen_date").alias("first_seen"), F.count("*").alias("total"), F.min(F.struct("first_seen_date", "primary_theme"))["primary_theme"].alias("theme"))
    return found.orderBy(F.desc("first_seen"), "advertiser_id", "product_name").limit(k)


def day_counts(ads: DataFrame) -> DataFrame:
    """Per advertiser, category and day: how many ads were launched, and the name of the latest of them."""
    latest = F.max_by("product_name", F.struct("first_seen_date", "product_name"))
    return ads.groupBy("advertiser_id", "product_category", F.to_date("first_seen_date").alias("day")).agg(F.count("*").alias("same_day"), latest.alias("latest_name"))


def trends(events: DataFrame, as_of: str, who: str, what: str, ts: str = "ts") -> DataFrame:
    """Week against the week before, share of voice over 30 days, velocity, top category."""
    day = lambda n: F.date_sub(F.lit(as_of).cast("date"), n).cast("timestamp_ntz")
    t = F.col(ts)
    rows = events.groupBy(who, what).agg(F.count_if(t >= day(7)).alias("week"), F.count_if((t >= day(14)) & (t < day(7))).alias("before"), F.count_if(t >= day(30)).alias("month"))
    rank = F.row_number().over(Window.partitionBy(who).orderBy(F.desc("month"), what))
    found = rows.withColumn("r", rank).groupBy(who).agg(F.sum("week").alias("week"), F.sum("before").alias("before"), F.sum("month").alias("month"), F.max(F.when(F.col("r") == 1, F.col(what))).alias("top"), F.max(F.when(F.col("r") == 1, F.col("month"))).alias("top_n"))
    found = shared(found, "month", "share_of_voice")
    change = F.try_divide(100.0 * (F.col("week") - F.col("before")), F.col("before"))
    direction = F.when(F.col("week") > F.col("before"), "up").when(F.col("week") < F.col("before"), "down").otherwise("stable")
    return found.select(who, "week", "before", direction.alias("trend"), F.round(F.abs(change), 0).alias("change_pct"), "share_of_voice", F.round(F.col("month") / 30.0, 2).alias("velocity"), "top", F.coalesce(F.round(F.try_divide(100.0 * F.col("top_n"), F.col("month")), 1), F.lit(0.0)).alias("top_pct"))


def theme_shift(ads: DataFrame) -> DataFrame:
    """Share of each theme in an advertiser's quarter, less that of the quarter before that has the theme."""
    counts = ads.groupBy("advertiser_id", F.to_date(F.date_trunc("quarter", "first_seen_date")).alias("period"), F.col("primary_theme").alias("theme")).agg(F.count("*").alias("n"))
    share = percent(F.col("n"), F.sum("n").over(Window.partitionBy("advertiser_id", "period")))
    shares = counts.withColumn("share", share)
    return shares.withColumn("shift", F.round(F.col("share") - F.lag("share").over(Window.partitionBy("advertiser_id", "theme").orderBy("period")), 1))


def coordinated_promos(ads: DataFrame, least: int = 3, leaving_out: str | None = None) -> DataFrame:
    """Days on which at least so many advertisers launched offers."""
    rows = ads.filter("offer_type <> 'none'")
    rows = rows.filter(F.col("advertiser_id") != leaving_out) if leaving_out else rows
    small = rows.groupBy(F.to_date("first_seen_date").alias("day"), "advertiser_id").agg(F.count("*").alias("n"))
    found = small.groupBy("day").agg(F.count("*").alias("advertisers"), F.array_join(F.array_sort(F.collect_list("advertiser_id")), "|").alias("who"), F.sum("n").alias("offers"))
    return found.filter(F.col("advertisers") >= least)


def vulnerability(ads: DataFrame, own: str, key: str = "product_category", least_gap: int = 5) -> DataFrame:
    """Categories in which competitors lead: own count, theirs, gap, ratio (null for none of one's own), the leader."""
    counts = valid(ads).groupBy(key, "advertiser_id").agg(F.count("*").alias("n"))
    mine = F.col("advertiser_id") == own
    rank = F.row_number().over(Window.partitionBy(key).orderBy(mine.cast("int"), F.desc("n"), "advertiser_id"))
    found = counts.withColumn("r", rank).groupBy(key).agg(F.sum(F.when(mine, F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(~mine, F.col("n")).otherwise(0)).alias("others"), F.max(F.when((F.col("r") == 1) & ~mine, F.col("advertiser_id"))).alias("leader"), F.max(F.when((F.col("r") == 1) & ~mine, F.col("n"))).alias("leader_n"))
    found = found.withColumn("gap", F.col("others") - F.col("own")).withColumn("ratio", F.round(F.try_divide(F.col("others").cast("double"), F.col("own")), 2))
    return found.filter(F.col("gap") > least_gap)


def day_blitz(ads: DataFrame, own: str, day: str) -> DataFrame:
    """One day's launches: own, competitors', ratio (0 for none of one's own)."""
    start = F.lit(day).cast("timestamp_ntz")
    rows = ads.filter((F.col("first_seen_date") >= start) & (F.col("first_seen_date") < start + F.expr("INTERVAL 1 DAY")))
    mine = F.col("advertiser_id") == own
    found = rows.agg(F.count_if(mine).alias("own"), F.count_if(~mine).alias("others"))
    return found.withColumn("ratio", F.coalesce(F.round(F.try_divide(F.col("others").cast("double"), F.col("own")), 2), F.lit(0.0)))


def day_breakdown(ads: DataFrame, own: str, day: str, by: str = "offer_type") -> DataFrame:
    """One day's launches by kind: own, competitors'."""
    start = F.lit(day).cast("timestamp_ntz")
    mine = F.col("advertiser_id") == own
    rows = ads.filter((F.col("first_seen_date") >= start) & (F.col("first_seen_date") < start + F.expr("INTERVAL 1 DAY")))
    return rows.groupBy(by).agg(F.count_if(mine).alias("own"), F.count_if(~mine).alias("others"))


def single_category(ads: DataFrame, own: str, category: str, column: str = "product_category") -> DataFrame:
    """Per advertiser the ads of one category, with the ratio to one's own (null for none) and the gap."""
    counts = valid(ads).filter(F.col(column) == category).groupBy("advertiser_id").agg(F.count("*").alias("n"))
    mine = counts.filter(F.col("advertiser_id") == own).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("own"))
    found = counts.filter(F.col("advertiser_id") != own).crossJoin(F.broadcast(mine))
    return found.withColumn("gap", F.col("n") - F.col("own")).withColumn("ratio", F.round(F.try_divide(F.col("n").cast("double"), F.col("own")), 2))


def visibility_what_if(ads: DataFrame, own: str) -> DataFrame:
    """Own share of all ads, and what it were with as many ads as the mean competitor."""
    mine = F.col("advertiser_id") == own
    found = valid(ads).agg(F.count_if(mine).alias("own"), F.count("*").alias("total"), F.countDistinct(F.when(~mine, F.col("advertiser_id"))).alias("competitors"))
    target = F.floor(F.try_divide(F.col("total") - F.col("own"), F.col("competitors")))
    found = found.withColumn("share", percent(F.col("own"), F.col("total"))).withColumn("target", target)
    return found.withColumn("new_share", percent(F.col("target"), F.col("total") - F.col("own") + F.col("target")))


def module_profile(ads: DataFrame, modules: dict[str, str]) -> DataFrame:
    """Per module (a column whose values may list several, split at ', '), advertiser: keys, top one, its share, and what
    percent it has of all keys that the market has there."""
    rows = valid(ads).select("advertiser_id", F.explode(F.array(*[F.struct(F.lit(m).alias("module"), F.col(c).alias("value")) for m, c in modules.items()])).alias("x")).select("advertiser_id", "x.module", F.explode(F.split("x.value", ", ")).alias("key"))
    counts = rows.groupBy("module", "advertiser_id", "key").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("module", "advertiser_id").orderBy(F.desc("n"), "key"))
    found = counts.withColumn("r", rank).groupBy("module", "advertiser_id").agg(F.count("*").alias("keys"), F.sum("n").alias("total"), F.max(F.when(F.col("r") == 1, F.col("key"))).alias("top"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("top_n"))
    market = counts.groupBy("module").agg(F.countDistinct("key").alias("market"))
    return found.join(F.broadcast(market), "module").withColumn("top_pct", percent(F.col("top_n"), F.col("total"))).withColumn("coverage_pct", percent(F.col("keys"), F.col("market"))).drop("market")


def quick_actions(ads: DataFrame, own: str) -> DataFrame:
    """The largest competitor, its ratio to one's own count (at least 1), and the verdict."""
    counts = valid(ads).groupBy("advertiser_id").agg(F.count("*").alias("n"))
    mine = counts.filter(F.col("advertiser_id") == own).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("own"))
    top = counts.filter(F.col("advertiser_id") != own).orderBy(F.desc("n"), "advertiser_id").limit(1).select(F.col("advertiser_id").alias("competitor"), "n")
    found = top.crossJoin(mine).withColumn("ratio", F.round(F.col("n").cast("double") / F.greatest("own", F.lit(1)), 2))
    return found.withColumn("verdict", F.when(F.col("n") > F.col("own"), "behind").otherwise("ahead"))


def weekly_summary(ads: DataFrame) -> DataFrame:
    """Leader, second, weakest, their counts, ratio, share and intensity of the market."""
    counts = valid(ads).groupBy("advertiser_id").agg(F.count("*").alias("n"))
    rank = F.struct((-F.col("n")).alias("r"), "advertiser_id")
    ends = counts.agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.sum("n").alias("total"), F.count("*").alias("advertisers"))
    second = counts.select(rank.alias("rank")).orderBy("rank").limit(2).agg(F.max("rank").alias("second"), F.count("*").alias("rows"))
    both = ends.crossJoin(second)
    at = lambda c: (F.col(f"{c}.advertiser_id"), -F.col(f"{c}.r"))
    found = both.select(at("first")[0].alias("leader"), at("first")[1].alias("leader_n"), *[F.when(F.col("rows") > 1, x).alias(n) for x, n in zip(at("second"), ("second", "second_n"), strict=True)], at("last")[0].alias("weakest"), at("last")[1].alias("weakest_n"), "total", "advertisers")
    mean = F.floor(F.col("total") / F.col("advertisers"))
    found = found.withColumn("mean", mean).withColumn("dominant", F.col("leader_n") >= 2.0 * F.col("second_n")).withColumn("leader_pct", F.floor(100 * F.col("leader_n") / F.col("total")))
    return found.withColumn("intensity", F.when(F.col("mean") > 90, "high").when(F.col("mean") < 40, "low").otherwise("medium")).withColumn("gap", F.col("leader_n") - F.col("weakest_n"))
