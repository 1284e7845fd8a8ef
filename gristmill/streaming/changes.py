"""Keyed change detection as a stateful stream whose answer doesn't depend on how its rows arrive.

A row waits in the state until the watermark has passed its moment; then a timer of
its key has it judged, in order with all others, against the state its key had before. So
late rows take their place among the earlier ones. A key that is silent for longer
than ``forget`` is forgotten, and its next row is a first sight again: silent.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Stateful processors need this store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Rows of one key in an element of its list.
TOGETHER = 10_000
CHANGE = "key string, at timestamp, before string, now string"


class _Changes(StatefulProcessor):
    """Each call to the state is a message to the JVM, so a key's rows of a batch are a few elements of its list and have one timer."""

    def __init__(self, forget_seconds: int):
        self.forget = forget_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, state string")
        self.waiting = handle.getListState("waiting", "ats array<long>, states array<string>")

    def _wait(self, rows: list[tuple[int, str | None]]) -> None:
        """Adds ``rows``, with a timer for the first of them."""
        for i in range(0, len(rows), TOGETHER):
            some = rows[i : i + TOGETHER]
            self.waiting.appendValue(([at for at, _ in some], [state for _, state in some]))
        self.handle.registerTimer(min(at for at, _ in rows))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._wait(list({(millis, state) for _, _, millis, state in rows}))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = {row for ats, states in self.waiting.get() for row in zip(ats, states, strict=True)}
        due = sorted((x for x in held if x[0] <= now), key=lambda x: (x[0], x[1] is not None, x[1] or ""))
        last = self.last.get() if self.last.exists() else None
        for at, state in due:
            if last is not None and at - last[0] <= self.forget and state != last[1]:
                yield Row(key=key[0], millis=at, before=last[1], now=state)
            last = (at, state)
        if due:
            self.waiting.clear()
            later = [x for x in held if x[0] > now]
            if later:
                self._wait(later)
        if last is not None and now > last[0] + self.forget:
            self.last.clear()
        elif due:
            self.last.update(last)
            self.handle.registerTimer(last[0] + self.forget + 1)

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str, at: str, state: str, lateness: str, forget_seconds: int) -> DataFrame:
    """key, at, before, now: each row whose state isn't the one its key had before, for rows at most ``lateness`` late.

    Rows of one key and moment are ordered by state; equal ones are one. Moments count in milliseconds.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.unix_millis(F.col(at)).alias("millis"), F.col(state).cast("string").alias("state"))
    out = rows.withWatermark("at", lateness).groupBy("key").transformWithState(_Changes(forget_seconds), "key string, millis long, before string, now string", "append", "EventTime")
    return out.select("key", F.timestamp_millis("millis").alias("at"), "before", "now")


def changes_of(table: DataFrame, key: str, at: str, state: str, forget_seconds: int) -> DataFrame:
    """What :func:`changes` tells of a whole table."""
    rows = table.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(at)).alias("millis"), F.col(state).cast("string").alias("now")).distinct()
    w = Window.partitionBy("key").orderBy("millis", F.col("now").asc_nulls_first())
    told = rows.select("key", "millis", "now", F.lag(F.struct("millis", "now")).over(w).alias("was"))
    near = F.col("millis") - F.col("was.millis") <= forget_seconds * 1000
    return told.where(F.col("was").isNotNull() & near & ~F.col("was.now").eqNullSafe(F.col("now"))).select("key", F.timestamp_millis("millis").alias("at"), F.col("was.now").alias("before"), "now")
