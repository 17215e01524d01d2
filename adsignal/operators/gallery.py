"""Views of single ads: the enriched view, pages of a gallery, what still lacks labels, recent offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enriched(ads: DataFrame, labels: DataFrame, key: str = "ad_id", advertiser: str | None = None, active_only: bool = True) -> DataFrame:
    """All ads with their labels, rejected ones left out; ads without labels stay."""
    rows = ads.filter("is_active") if active_only else ads
    rows = rows.filter(F.col("advertiser_id") == advertiser) if advertiser else rows
    joined = rows.join(labels, key, "left").filter(~F.coalesce("rejected_wrong_region", F.lit(False)))
    if "messaging_themes" in labels.columns:
        joined = joined.withColumn("messaging_themes", F.from_json("messaging_themes", "map<string,double>"))
    return joined


def proxy_link(url: Column, prefix: str) -> Column:
    """A link to an image by way of a proxy; null stays null.  Slashes stay, spaces are %20."""
    quoted = F.replace(F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit(prefix), quoted)


def gallery(rows: DataFrame, key: str, n: int, keep: Column, after: Column | None = None) -> DataFrame:
    """A page: the first n rows by key that pass the filter, behind a key if given, with the number of all that pass."""
    kept = rows.filter(keep)
    total = kept.agg(F.count("*").alias("total"))
    page = (kept if after is None else kept.filter(F.col(key) > after)).orderBy(key).limit(n)
    return page.crossJoin(F.broadcast(total))


def unlabelled(rows: DataFrame, category: str, general: tuple[str, ...] = ("Other", "General", "Unknown")) -> DataFrame:
    """Rows without a category ('missing') or with a general one ('general')."""
    c = F.col(category)
    why = F.when(F.coalesce(c, F.lit("")) == "", "missing").when(c.isin(*general), "general")
    return rows.withColumn("why", why).filter("why IS NOT NULL")


def named(rows: DataFrame, names: DataFrame, key: str, drop_unknown: bool = False) -> DataFrame:
    """rows with ``display_name``: the name, or the id."""
    joined = rows.join(names.select(F.col(key), F.col("name").alias("_name")), key, "left")
    joined = joined.filter("_name IS NOT NULL") if drop_unknown else joined
    return joined.withColumn("display_name", F.coalesce("_name", F.col(key).cast("string"))).drop("_name")


def detection_lag(ads: DataFrame, own: str, k: int = 5) -> DataFrame:
    """The latest offers of competitors by day: when a manual look (7 days) and an alert (1 day) would find them."""
    rows = ads.filter((F.col("advertiser_id") != own) & (F.col("offer_type") != "none"))
    days = rows.groupBy("advertiser_id", "offer_type", F.to_date("first_seen_date").alias("day")).agg(F.count("*").alias("n"))
    shown = lambda d: F.date_format(F.date_add("day", d), "MMM dd, yyyy")
    return days.orderBy(F.desc("day"), F.desc("n"), "advertiser_id", "offer_type").limit(k).select("advertiser_id", "offer_type", "n", shown(0).alias("launched"), shown(7).alias("manual"), shown(1).alias("alert"))


def campaign_range(ads: DataFrame) -> DataFrame:
    """Per advertiser the first and last launch."""
    return ads.groupBy("advertiser_id").agg(F.min("first_seen_date").alias("first_seen"), F.max("first_seen_date").alias("last_seen"), F.count("*").alias("ads"))


def deltas(runs: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Change of a value since the check before."""
    return runs.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(at)))


def latest(rows: DataFrame, at: str, key: str, n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(at), key).limit(n)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("Unknown")).alias("value")).agg(F.count("*").alias("n"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Over runs (advertiser_id, ads_new, ads_updated, ads_retired, error): totals, successes and failures."""
    return runs.agg(F.sum("ads_new").alias("ads_new"), F.sum("ads_updated").alias("ads_updated"), F.sum("ads_retired").alias("ads_retired"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
