"""Stateful streams, the merged store, the cube and sketches on small fixtures."""

import datetime
import pathlib

from pyspark.sql import functions as F

from adsignal.operators import distinct
from adsignal.streaming import jobs, stateful, store

SEEN = "user_id long, ts timestamp_ntz"


def at(day, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)


def runs(spark, parts, make):
    with stateful.keyed_state(spark):
        return jobs.in_runs([spark.createDataFrame(p, SEEN) for p in parts], make)


def test_retired_by_timer_and_active_again(spark):
    events = [(1, at(0)), (1, at(1)), (2, at(0, 5)), (1, at(9)), (2, at(9)), (3, at(20)), (3, None)]
    make = lambda e: stateful.lifecycle(e, "user_id", "3 days", "1 day")
    want = {(1, "active", at(0), 1), (1, "retired", at(4), 2), (2, "active", at(0, 5), 1), (2, "retired", at(3, 5), 1), (1, "active", at(9), 1), (2, "active", at(9), 1), (1, "retired", at(12), 1), (2, "retired", at(12), 1)}
    for cut in (len(events), 1, 3, 5):
        rows = runs(spark, [p for p in (events[:cut], events[cut:]) if p], make).collect()
        assert {(r.user_id, r.change, r["at"], r.n) for r in rows} == want and len(rows) == len(want)


def test_state_of_retired_ads_is_dropped(spark, tmp_path):
    schema = "user_id long, ts timestamp_ntz"
    held = []
    with stateful.keyed_state(spark):
        for part in ([(n, at(0)) for n in range(200)], [(1, at(30))], [(1, at(60))]):
            spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = jobs.events_stream(spark, str(tmp_path / "in"), "*.parquet", schema)
            query = stateful.lifecycle(stream, "user_id", "3 days", "1 day").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).foreachBatch(lambda batch, _: batch.count()).start()
            query.awaitTermination()
            held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[0] >= 200 and held[-1] < 20


def test_weeks_compared_over_runs(spark):
    events = [(2, at(0))] + [(1, at(d)) for d in range(10) for _ in range(d % 3 + 1)] + [(1, at(40)), (2, at(45))]
    make = lambda e: stateful.weeks_compared(e, "user_id", "1 day")
    counts = {}
    for user, t in events:
        counts[user, t.toordinal()] = counts.get((user, t.toordinal()), 0) + 1
    want = set()
    for user in (1, 2):
        for day in range(at(0).toordinal(), at(44).toordinal()):
            week, before = (sum(counts.get((user, d), 0) for d in range(day - s - 6, day - s + 1)) for s in (0, 7))
            if week:
                want.add((user, datetime.date.fromordinal(day - 6), week, before or None))
    for cut in (len(events), 7, 20):
        rows = runs(spark, [p for p in (events[:cut], events[cut:]) if p], make).collect()
        assert {(r.user_id, r.start.date(), r.n, r.before) for r in rows} == want and len(rows) == len(want)


ADS = "advertiser_id string, ad_text string, image_url string"


def test_store_rewrites_touched_partitions_alone_and_takes_a_batch_once(spark, tmp_path):
    ads = store.AdStore(spark, str(tmp_path / "store"))
    files = lambda who: {p.name for p in pathlib.Path(tmp_path / "store" / f"advertiser_id={who}").glob("*.parquet")}
    rows = lambda: sorted(map(str, ads.rows().drop("batch").collect()))
    assert ads.rows().count() == 0
    ads.merge(spark.createDataFrame([("a", "x", None), ("a", "y", ""), ("b", "z", ""), (None, "q", "")], ADS), 0, "2024-01-01")
    kept, before = files("b"), files("a")
    ads.merge(spark.createDataFrame([("a", "x", ""), ("c", "n", "")], ADS), 1, "2024-02-01")
    assert files("b") == kept and not files("a") & before
    found = {(r.advertiser_id, r.ad_text): (str(r.first_seen_date)[:7], str(r.last_seen_date)[:7], r.is_active) for r in ads.rows().collect()}
    assert found == {("a", "x"): ("2024-01", "2024-02", True), ("a", "y"): ("2024-01", "2024-02", False), ("b", "z"): ("2024-01", "2024-01", True), ("c", "n"): ("2024-02", "2024-02", True)}
    after, held = rows(), files("a") | files("b") | files("c")
    ads.merge(spark.createDataFrame([("a", "x", ""), ("c", "n", "")], ADS), 1, "2024-02-01")
    ads.merge(spark.createDataFrame([("a", "x", None), ("a", "y", ""), ("b", "z", "")], ADS), 0, "2024-01-01")
    ads.merge(spark.createDataFrame([], ADS), 7, "2025-01-01")
    assert rows() == after and files("a") | files("b") | files("c") == held
    # One partition has seen batch 2, the other has not: the repetition mends the other alone.
    ads.merge(spark.createDataFrame([("a", "w", "")], ADS), 2, "2024-03-01")
    half = files("a")
    ads.merge(spark.createDataFrame([("a", "w", ""), ("c", "w", "")], ADS), 2, "2024-03-01")
    assert files("a") == half and ads.rows().filter("advertiser_id = 'c'").count() == 2


def test_cube_of_ten_runs_is_a_recount(spark, tmp_path):
    cube, total = store.Cube(spark, str(tmp_path / "cube"), "day date, who string", ["n", "active"]), {}
    for number in range(10):
        rows = [(datetime.date(2024, 1, 1 + k % 3), f"w{(k + number) % 4}", 1, (-1) ** (k + number)) for k in range(number + 3)]
        for day, who, n, active in rows:
            a, b = total.get((day, who), (0, 0))
            total[day, who] = (a + n, b + active)
        changes = spark.createDataFrame(rows, "day date, who string, n int, active int")
        cube.add(changes, number)
        cube.add(changes, number)
        if number in (3, 7):
            cube.fold(number)
            cube.fold(number)
    assert {(r.day, r.who): (r.n, r.active) for r in cube.rows().collect()} == {k: v for k, v in total.items() if v != (0, 0)}
    read = {pathlib.Path(f).parent.name for f in cube.rows().inputFiles()}
    assert "upto=7" in read and read <= {"upto=7", *(f"run={n}" for n in range(10))}


def test_sketches_add_up(spark):
    rows = spark.range(30_000).select((F.col("id") % 9000).alias("who"), F.timestamp_seconds(F.col("id") * 20).alias("ts"), F.lit("x").alias("kind"))
    whole = distinct.daily_sketches(rows, "who", ["kind"])
    split = distinct.added(distinct.daily_sketches(rows.filter("id % 2 = 0"), "who", ["kind"]), distinct.daily_sketches(rows.filter("id % 2 = 1"), "who", ["kind"]), ["kind"])
    for days in (1, 3, 7):
        exact = {r.day: r.n for r in rows.select(F.explode(F.expr(f"sequence(to_date(ts), date_add(to_date(ts), {days - 1}))")).alias("day"), "who").groupBy("day").agg(F.countDistinct("who").alias("n")).collect()}
        for stored in (whole, split):
            found = {r.day: r.who for r in distinct.in_windows(stored, days, ["kind"]).collect()}
            assert found.keys() == exact.keys() and all(abs(found[d] - n) <= distinct.error() * n for d, n in exact.items())
