"""The same work on streams: intake without repeats, daily velocity, trends, alerts, ad state, bursts.

Event times must be timestamps; ``events_stream`` casts them.  Sinks are the caller's, but for ``drained``, which runs a
query over what there is and returns its rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.distinct import SIZE
from ..sources.scratch import scratch

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events_stream(spark: SparkSession, folder: str, pattern: str, schema=EVENTS) -> DataFrame:
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def velocity(events: DataFrame, key: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def trend(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Seven-day counts, a window a day."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def compared(counts: DataFrame, key: str, at: str = "start") -> DataFrame:
    """Seven-day counts next to those of the seven days before: direction and whole percent (null without any before).

    ``counts`` is what ``trend`` has written so far, or a batch of it in ``foreachBatch`` joined with what is stored.
    """
    before = counts.select(F.col(key), (F.col(at) + F.expr("INTERVAL 7 DAYS")).alias(at), F.col("n").alias("before"))
    joined = counts.join(before, [key, at], "left")
    change = F.round(F.try_divide(100.0 * (F.col("n") - F.col("before")), F.col("before")), 0)
    way = F.when(F.col("before").isNull(), "new").when(F.col("n") > F.col("before"), "up").when(F.col("n") < F.col("before"), "down").otherwise("stable")
    return joined.withColumn("change_pct", change).withColumn("trend", way)


def coordinated(events: DataFrame, who: str, least: int = 3, late: str = "1 day") -> DataFrame:
    """Days on which at least so many different ones are active."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.size(F.collect_set(who)).alias("who"), F.count("*").alias("n"))
    return days.select(F.col("window.start").alias("day"), "who", "n").filter(F.col("who") >= least)


def coordinated_at_size(events: DataFrame, who: str, least: int = 3, late: str = "1 day", size: int = SIZE) -> DataFrame:
    """``coordinated`` with a sketch of fixed size as the state of a day, in place of the set of all: ``who`` is an estimate
    (``distinct.error``), and ``sketch`` goes into the store of daily sketches."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.hll_sketch_agg(who, F.lit(size)).alias("sketch"), F.count("*").alias("n"))
    return days.select(F.col("window.start").alias("day"), F.hll_sketch_estimate("sketch").alias("who"), "n", "sketch").filter(F.col("who") >= least)


def state(events: DataFrame, key: str) -> DataFrame:
    """First and last time of each key, for update mode."""
    return events.groupBy(key).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def retired(states: DataFrame, key: str, gap: str = "7 days") -> DataFrame:
    """``state``'s rows with ``is_active``: seen within the gap before the latest time of all."""
    latest = states.agg(F.max("last_seen").alias("latest"))
    return states.crossJoin(F.broadcast(latest)).withColumn("is_active", F.col("last_seen") >= F.col("latest") - F.expr(f"INTERVAL {gap}")).drop("latest")


def bursts(events: DataFrame, key: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def progress(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"))


def drained(query: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All rows that the query gives for what is there now, written to a folder that driver and executors share."""
    spark = query.sparkSession
    place = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/{'all' if mode == 'complete' else number}")

    spark.createDataFrame([], query.schema).write.parquet(f"{place}/out/none")
    run = query.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return spark.read.schema(query.schema).option("recursiveFileLookup", True).parquet(f"{place}/out")


def in_runs(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a query gives over several runs, each of which begins where the one before has stopped: new files come between
    them, one part at a time.  ``make`` gets the stream of all parts' rows."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    place = scratch(spark, "runs")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/{number}")

    kinds = None
    for part in parts:
        part.write.mode("append").parquet(f"{place}/in")
        query = make(events_stream(spark, f"{place}/in", "*.parquet", schema))
        kinds = query.schema
        query.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(f"{place}/out")


def days_with_late_events(events: DataFrame, late: Column, lateness: str) -> DataFrame:
    """Counts a day where some events come after all others: two runs of one query, on what is there and on what came."""
    spark = events.sparkSession
    place = scratch(spark, "late")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/{number}")

    for part in (events.filter(~late), events.filter(late)):
        part.write.mode("append").parquet(f"{place}/in")
        days = events_stream(spark, f"{place}/in", "*.parquet", events.schema).withWatermark("ts", lateness).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
        query = days.select(F.col("window.start").alias("start"), "n")
        query.writeStream.outputMode("update").option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.schema(query.schema).option("recursiveFileLookup", True).parquet(f"{place}/out")
    return out.groupBy("start").agg(F.max("n").alias("n"))
