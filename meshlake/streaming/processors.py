"""Stateful operators with event-time timers (STR-06, STR-07): state for each key, results when the watermark passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000


class Absences(StatefulProcessor):
    """The latest day on which a key was present, and a timer at the day after the last one counted."""

    def __init__(self, forget_after: int | None):
        self.forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "day long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day = max(int(x["day"].max()) for x in rows)
        if self.last.exists() and self.last.get()[0] >= day:
            return  # an older row changes nothing
        self.last.update((day,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((day + 1) * DAY)
        yield pd.DataFrame({"key": [key[0]], "as_of": [day], "absent": [0]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        as_of, last = timerValues.getCurrentWatermarkInMs() // DAY, self.last.get()[0]
        if self.forget_after is not None and as_of - last >= self.forget_after:
            self.last.clear()
        else:
            self.handle.registerTimer((as_of + 1) * DAY)
        yield pd.DataFrame({"key": [key[0]], "as_of": [as_of], "absent": [as_of - last]})

    def close(self) -> None:
        pass


def absences(events: DataFrame, key: str, time: str, late: str = "0 seconds", forget_after: int | None = None) -> DataFrame:
    """STR-06: key, as_of (day number), absent (days since the key's latest presence), whenever it changes.

    A presence gives 0; a day that the watermark reaches without one counts (0 follows if the key turns up on that day after all). Rows later than the watermark are dropped,
    older days than the latest one change nothing. A key that is absent for ``forget_after`` days is told a last time and leaves the state.
    """
    rows = events.withWatermark(time, late).select(F.col(key).cast("long").alias("key"), time, F.expr(f"unix_millis({time}) div {DAY}").alias("day"))
    return rows.groupBy("key").transformWithStateInPandas(Absences(forget_after), "key long, as_of long, absent long", "Update", "EventTime")


class Changes(StatefulProcessor):
    """Rows of a key that the watermark hasn't passed, and the value of the last one that it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.before = handle.getValueState("before", "value double")
        self.waiting = handle.getListState("waiting", "ms long, us long, id long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for x in rows:
            self.waiting.appendList(list(x[["ms", "us", "id", "value"]].itertuples(index=False, name=None)))
            due.add(int(x["ms"].min()))
        self.handle.registerTimer(min(due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(x) for x in self.waiting.get())
        ready, rest = [x for x in rows if x[0] <= until], [x for x in rows if x[0] > until]
        before, out = (self.before.get()[0] if self.before.exists() else None), []
        for _, _, id_, value in ready:
            kind = "first" if before is None else "reset-detected" if value < before else "delta"
            out.append((key[0], id_, kind, value - before if kind == "delta" else None))
            before = value
        if ready:
            self.before.update((before,))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        yield pd.DataFrame(out, columns=["key", "id", "kind", "delta"]).astype({"kind": object, "delta": "float64"})

    def close(self) -> None:
        pass


def counter_changes(events: DataFrame, key: str, time: str, id_: str, value: str, late: str = "0 seconds") -> DataFrame:
    """STR-07: key, id, kind (first, reset-detected, delta), delta: each value against the one before it in event time, whatever order and batches rows come in.

    Rows wait until the watermark has passed them; of equal times the lower id is first; rows later than the watermark are dropped.
    """
    rows = events.withWatermark(time, late).select(
        F.col(key).cast("long").alias("key"), time, F.unix_millis(time).alias("ms"), F.unix_micros(time).alias("us"), F.col(id_).cast("long").alias("id"), F.col(value).cast("double").alias("value")
    )
    return rows.groupBy("key").transformWithStateInPandas(Changes(), "key long, id long, kind string, delta double", "Append", "EventTime")
