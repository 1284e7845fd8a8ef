"""Date expressions: ISO weeks, local days, windows and deadlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(day: Column) -> Column:
    """``2027-W53`` style label; the year is the ISO year."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def week_bounds(label: Column) -> Column:
    """Struct (start, end): Monday and Sunday of a ``2027-W53`` label; null for what is none, also for a week its year doesn't have."""
    year, week = (F.nullif(F.regexp_extract(label, r"^(\d{4})-W(\d{2})$", g), F.lit("")).cast("int") for g in (1, 2))
    # the fourth of January lies in the first week
    start = F.date_add(week_start(F.make_date(year, F.lit(1), F.lit(4))), (week - 1) * 7)
    return F.when((week >= 1) & (iso_week(start) == label), F.struct(start.alias("start"), F.date_add(start, 6).alias("end")))


def first_week_end_of_month(day: Column) -> Column:
    """Whether the Sunday of the day's week is one of the first seven days of its month."""
    return F.dayofmonth(F.date_add(week_start(day), 6)) <= 7


def local_day(moment: Column, zone: str) -> Column:
    """The calendar day in ``zone`` of a UTC moment without zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), moment.cast("timestamp_ntz")))


def within_days(day: Column, today: Column, days: int) -> Column:
    """Whether ``day`` is today or at most ``days`` ahead; null days are not."""
    return F.coalesce(F.datediff(day, today).between(0, days), F.lit(False))


def stalled_days(since: Column, today: Column, patience: Column, default: int = 180) -> Column:
    """Days since, where they exceed the phase's patience; null otherwise."""
    gone = F.datediff(today, since)
    return F.when(gone > F.coalesce(patience, F.lit(default)), gone)


def next_release(moment: Column, zone: str, hour: int, most_hours: int = 24) -> Column:
    """The next local ``hour`` after a UTC moment, but at most ``most_hours`` of elapsed time later."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), moment.cast("timestamp_ntz"))
    today = F.date_trunc("day", local).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))
    due = F.when(local < today, today).otherwise(today + F.make_dt_interval(days=F.lit(1)))
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), due)
    return F.least(utc, moment.cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(most_hours)))
