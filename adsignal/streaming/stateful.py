"""Stateful operators with event-time timers: ads that turn active and retire, and week against week as days close.

Both wait for the watermark and then take events in order of their time, so what they give does not depend on how the
input was cut into batches.  State is a few numbers a key, and is gone when the key's timer has run out.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While a query with timers starts, the session's state store is one that has them."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def times(values: list[int | None]) -> pd.Series:
    return pd.Series(pd.to_datetime(values, unit="us"), dtype="datetime64[us]")


class _Periods(StatefulProcessor):
    """Sightings wait in ``pending`` until the watermark has passed them; ``period`` is the active one."""

    def __init__(self, gap: int, key: str) -> None:
        self.gap, self.key = gap, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long")
        self.period = handle.getValueState("period", "first long, last long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            seen = micros(batch["ts"])
            self.pending.appendList([(t,) for t in seen])
            self._wake(-(-min(seen) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(t for (t,) in self.pending.get())
        period, out = self.period.get() if self.period.exists() else None, []
        due, later = [t for t in waiting if t <= now], [t for t in waiting if t > now]
        for t in [*due, None]:
            if period and period[1] + self.gap <= (now if t is None else t):
                out.append(("retired", period[1] + self.gap, *period))
                period = None
            if t is None:
                continue
            if period is None:
                out.append(("active", t, t, t, 1))
                period = (t, t, 0)
            period = (period[0], t, period[2] + 1)
        if due:
            self.pending.put([(t,) for t in later]) if later else self.pending.clear()
        self.period.update(period) if period else self.period.clear()
        for timer in list(self.handle.listTimers()):
            if timer <= now // 1000:
                self.handle.deleteTimer(timer)
        wake = [later[0]] if later else []
        wake += [period[1] + self.gap] if period else []
        if wake:
            self._wake(-(-min(wake) // 1000))
        if out:
            change, at, first, last, n = zip(*out, strict=True)
            yield pd.DataFrame({self.key: [key[0]] * len(out), "change": change, "at": times(list(at)), "first_seen": times(list(first)), "last_seen": times(list(last)), "n": n})

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def lifecycle(sightings: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Changes of each ad: key, change (active, retired), at, first_seen, last_seen, n (sightings of the period so far).

    An ad turns active when it is seen, and retires when ``gap`` has passed without it; then its state is dropped, and the
    next sighting makes it active again.  Changes come once the watermark (``late`` behind the latest sighting) has passed
    them.  ``sightings``: key, ts.  Run it within ``keyed_state``.
    """
    kind = sightings.schema[key].dataType.simpleString()
    waited = sightings.select(key, "ts").filter(F.col("ts").isNotNull()).withWatermark("ts", late)
    length = pd.Timedelta(gap).value // 1000
    return waited.groupBy(key).transformWithStateInPandas(_Periods(length, key), f"`{key}` {kind}, change string, at timestamp_ntz, first_seen timestamp_ntz, last_seen timestamp_ntz, n long", "Append", "EventTime")


class _Weeks(StatefulProcessor):
    """``days`` holds the counts of at most as many days as two weeks and the lateness have."""

    def __init__(self, width: int, key: str) -> None:
        self.width, self.key = width, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "n long")
        self.closed = handle.getValueState("closed", "day long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            for day, n in pd.Series(micros(batch["ts"])).floordiv(DAY).value_counts().items():
                known = self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0
                self.days.updateValue((day,), (known + int(n),))
                self.handle.registerTimer((day + 1) * DAY // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        counts = {day: n for (day,), (n,) in self.days.iterator()}
        last = now // DAY - 1  # the latest day that is over
        day = self.closed.get()[0] + 1 if self.closed.exists() else min(counts)
        out = []
        while day <= last and counts:
            week, before = (sum(counts.get(d, 0) for d in range(day - shift - self.width + 1, day - shift + 1)) for shift in (0, self.width))
            if week:
                out.append((day - self.width + 1, week, before or None))
            old = [d for d in counts if d <= day - 2 * self.width + 1]
            for d in old:
                del counts[d]
                self.days.removeKey((d,))
            day += 1
        if counts:
            self.closed.update((day - 1,))
            self.handle.registerTimer((max(day, last + 1) + 1) * DAY // 1000)
        else:
            self.closed.clear()
        if out:
            start, week, before = zip(*out, strict=True)
            yield pd.DataFrame({self.key: [key[0]] * len(out), "start": times([d * DAY for d in start]), "n": week, "before": pd.array(before, dtype="Int64")})

    def close(self) -> None:
        pass


def weeks_compared(events: DataFrame, key: str, late: str, days: int = 7) -> DataFrame:
    """Counts of so many days next to those of as many days before, for every day that is over: key, start, n, before,
    change_pct (whole percent), trend (new, up, down, stable).

    A row comes when the watermark has passed the window's last day; days without any event in the window give none.  Run
    it within ``keyed_state``.
    """
    kind = events.schema[key].dataType.simpleString()
    waited = events.select(key, "ts").filter(F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = waited.groupBy(key).transformWithStateInPandas(_Weeks(days, key), f"`{key}` {kind}, start timestamp_ntz, n long, before long", "Append", "EventTime")
    way = F.when(F.col("before").isNull(), "new").when(F.col("n") > F.col("before"), "up").when(F.col("n") < F.col("before"), "down").otherwise("stable")
    return rows.withColumn("change_pct", F.round(100.0 * (F.col("n") - F.col("before")) / F.col("before"), 0)).withColumn("trend", way)
