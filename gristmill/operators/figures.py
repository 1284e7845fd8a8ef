"""Rollups: conditional counts, guarded figures, merged maps, costs, latencies, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_counts(rows: DataFrame, keys: Sequence[Column], conditions: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def guarded_sum(value: Column) -> Column:
    """The sum, or null if any row lacks the value."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def merged_maps(rows: DataFrame, keys: Sequence[Column], map_col: str) -> DataFrame:
    """Maps of counters added up key by key, one row an entry."""
    return rows.select(*keys, F.explode(map_col).alias("entry", "amount")).groupBy(*[F.col(c) for c in rows.select(*keys).columns], "entry").agg(F.sum("amount").alias("amount"))


def total_cost(rows: DataFrame, keys: Sequence[Column], price: Column, amount: Column, factor: Column | None = None) -> DataFrame:
    """Sum of price times amount; null if a price is unknown."""
    each = price * amount * (factor if factor is not None else F.lit(1.0))
    return rows.groupBy(*keys).agg(guarded_sum(each).alias("cost"), F.count_if(price.isNull()).alias("unpriced"))


def span_or_reason(start: Column, end: Column, now: Column) -> tuple[Column, Column]:
    """(seconds, null), or (null, why there is no span)."""
    reason = (
        F.when(start.isNull(), "no start").when(end.isNull(), "no end").when((start > now) | (end > now), "in the future").when(end < start, "reversed")
    )
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(reason.isNull(), micros / 1e6), reason


def coverage(rows: DataFrame, keys: Sequence[str], value: str, reason: str) -> DataFrame:
    """Known values and reasons of unknown ones, a row each."""
    return rows.groupBy(*keys, F.coalesce(reason, F.lit("known")).alias("state")).agg(F.count("*").alias("n"), F.round(F.avg(value), 3).alias("mean"))


def majority_value(rows: DataFrame, keys: Sequence[str], value: str, least_rows: int) -> DataFrame:
    """The value that more than half of a group's rows have, in groups of at least ``least_rows``."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return (
        counts.groupBy(*keys)
        .agg(F.sum("n").alias("rows"), F.max(F.struct(F.col("n").alias("n"), F.col(value).alias("v"))).alias("top"))
        .where((F.col("rows") >= least_rows) & (F.col("top.n") * 2 > F.col("rows")))
        .select(*keys, "rows", F.col("top.v").alias("majority"), F.col("top.n").alias("n"))
    )


def census(rows: DataFrame, keys: Sequence[str], content: Column, size: Column) -> DataFrame:
    """Files, bytes, distinct contents and their bytes."""
    per = rows.select(*keys, content.alias("_c"), size.alias("_s")).groupBy(*keys, "_c").agg(F.count("*").alias("_n"), F.max("_s").alias("_s"))
    return per.groupBy(*keys).agg(
        F.sum("_n").alias("files"), F.sum(F.col("_n") * F.col("_s")).alias("bytes"), F.count("*").alias("unique_files"), F.sum("_s").alias("unique_bytes")
    )
