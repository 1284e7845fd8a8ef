"""Sittings matched with what they are about, and with what was told of them before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import roman_value


def matched(rows: DataFrame, key: str, numbers: str, sittings: DataFrame, ref: str, named: str, meeting: Sequence[str], told: DataFrame) -> DataFrame:
    """``key``, the columns of ``sittings``, ``shared``: for each row the sittings that name one of its numbers, each meeting once.

    Several listings of one meeting are one: of these one whose ``ref`` was ``told`` (key, ref) for the row
    stays, else the smallest ref. Both lists of numbers are exploded and meet by
    equality; null and empty lists meet nothing.
    """
    own = rows.select(F.col(key).alias("own"), F.explode(F.array_distinct(numbers)).alias("number"))
    listed = sittings.select(F.struct(*sittings.columns).alias("sitting"), F.explode(F.array_distinct(named)).alias("number"))
    met = own.join(listed, "number").groupBy("own", "sitting").agg(F.array_sort(F.collect_list("number")).alias("shared"))
    met = met.withColumn("ref", F.col(f"sitting.{ref}"))
    known = told.select(F.col(key).alias("own"), F.col(ref).alias("ref"), F.lit(0).alias("rank")).distinct()
    met = met.join(known, ["own", "ref"], "left")
    places = [F.col(f"sitting.{m}").alias(f"m{i}") for i, m in enumerate(meeting)]
    best = F.min(F.struct(F.coalesce("rank", F.lit(1)).alias("rank"), "ref", "sitting", "shared")).alias("best")
    kept = met.groupBy("own", *places).agg(best)
    return kept.select(F.col("own").alias(key), "best.sitting.*", "best.shared")


def moved(items: DataFrame, told: DataFrame, keys: Sequence[str], ref: str, day: str) -> DataFrame:
    """``items`` with ``moved_from``, the latest other ``ref`` under which the same sitting (``keys``) was told."""
    before = told.select(*keys, F.struct(F.col(day).alias("day"), F.col(ref).alias("ref")).alias("was")).distinct()
    met = items.select(*keys, F.col(ref).alias("own")).distinct().join(before, list(keys)).where(F.col("was.ref") != F.col("own"))
    last = met.groupBy(*keys, F.col("own").alias(ref)).agg(F.max("was").alias("was")).select(*keys, ref, F.col("was.ref").alias("moved_from"))
    return items.join(last, [*keys, ref], "left")


def covers(items: Column, numbers: Column, points: Column, number: str, numeral: str) -> Column:
    """Whether a condition on ``points`` is about an item that names one of ``numbers``.

    An item's point is the numeral it opens with (the first group of ``numeral``), else its
    place in ``items``; no points are all of them. ``number`` finds the numbers in an item.
    """
    point = lambda item, i: F.coalesce(roman_value(F.nullif(F.regexp_extract(item, numeral, 1), F.lit(""))), i + 1)
    about = F.transform(items, lambda item, i: F.struct(point(item, i).alias("point"), F.arrays_overlap(F.regexp_extract_all(item, F.lit(number), F.lit(1)), numbers).alias("named")))
    return (F.size(points) == 0) | F.exists(about, lambda x: x["named"] & F.array_contains(points, x["point"]))
