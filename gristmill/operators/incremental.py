"""State between scheduled runs: watermark, retention, outbox, schedules, covered ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def low_watermark(runs: DataFrame, started: str, ok: Column, overlap_days: int, now: Column, lookback_days: int) -> DataFrame:
    """One row, ``since``: the last successful start less an overlap; without one, ``lookback_days`` before now."""
    days = lambda n: F.make_dt_interval(days=F.lit(n))
    return runs.agg(F.coalesce(F.max(F.when(ok, F.col(started))) - days(overlap_days), now - days(lookback_days)).alias("since"))


def retained(runs: DataFrame, key: str, started: str, anchor: Column, before: Column) -> DataFrame:
    """Runs from ``before`` on, and the newest one that ``anchor`` holds for, whatever its age (ties: the largest key)."""
    newest = runs.where(anchor).agg(F.max(F.struct(started, key))[key].alias("k"))
    return runs.where(F.coalesce((F.col(started) >= before) | (F.col(key) == newest.scalar()), F.lit(False)))


def swept(outbox: DataFrame, status: str, error: str, note: str, pending: str = "pending", unknown: str = "unknown") -> DataFrame:
    """Rows that a crashed run left pending become unknown, with a note; they are never sent again."""
    left = F.col(status).eqNullSafe(F.lit(pending))
    return outbox.withColumns({status: F.when(left, unknown).otherwise(F.col(status)), error: F.when(left, note).otherwise(F.col(error))})


def due_again(outbox: DataFrame, status: str, attempts: str, most: int, failed: str = "failed") -> DataFrame:
    """Failed rows that have attempts left; null attempts count as none."""
    return outbox.where((F.col(status) == failed) & (F.coalesce(attempts, F.lit(0)) < most))


def schedule_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """keys, was, day, state (new, moved, cancelled) of entries that changed; the two tables have one row a key."""
    was = old.select(*keys, F.col(day).alias("was"), F.lit(True).alias("_old"))
    now = new.select(*keys, F.col(day), F.lit(True).alias("_new"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "cancelled").when(~F.col("was").eqNullSafe(F.col(day)), "moved")
    return was.join(now, list(keys), "full").withColumn("state", state).where("state IS NOT NULL").select(*keys, "was", day, "state")


def merged_ranges(ranges: Column) -> Column:
    """Ranges ``start, end`` of bigints in order, joined where they touch or overlap."""
    one = lambda a, b: F.struct(a.alias("start"), b.alias("end"))

    def add(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        grown = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(one(last["start"], F.greatest(last["end"], x["end"]))))
        return F.when((F.size(held) > 0) & (x["start"] <= F.try_element_at(held, F.lit(-1))["end"]), grown).otherwise(F.concat(held, F.array(one(x["start"], x["end"]))))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def ranges_cover(actual: Column, required: Column) -> Column:
    """Whether each required range lies within the joined actual ones; nothing required is not covered."""
    merged = merged_ranges(F.coalesce(actual, F.array().cast("array<struct<start:bigint,end:bigint>>")))
    inside = F.forall(required, lambda r: F.exists(merged, lambda m: (m["start"] <= r["start"]) & (r["end"] <= m["end"])))
    return F.coalesce((F.size(required) > 0) & inside, F.lit(False))
