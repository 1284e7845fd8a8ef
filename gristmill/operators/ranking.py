"""Order: top rows, pages, versions, stable re-ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.names import free


def top(rows: DataFrame, order: Sequence[Column], n: int, offset: int = 0) -> DataFrame:
    """``n`` rows by ``order`` after ``offset``; end ``order`` with a unique column."""
    out = rows.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(n)


def best_per(rows: DataFrame, keys: Sequence[str], rank: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """The row of each key with the least rank, as one aggregate, so ties in keys cost no sort."""
    least = F.min(F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], *payload)).alias("_b")
    return rows.groupBy(*keys).agg(least).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in payload])


def hoisted(rows: DataFrame, group: Sequence[str], position: str, first: Column) -> DataFrame:
    """Rows of a group keep their order, except that those with ``first`` move before the others."""
    w = Window.partitionBy(*group).orderBy(F.when(first, 0).otherwise(1), position)
    return rows.withColumn("new_position", F.row_number().over(w))


def replaced_by_slot(rows: DataFrame, group: Sequence[str], slot: str, position: str, entry: str) -> DataFrame:
    """The last entry of a slot wins, at the place of the slot's first one."""
    return rows.groupBy(*group, slot).agg(F.min(position).alias("place"), F.max_by(entry, position).alias("entry"))


def with_previous(rows: DataFrame, group: Column, order: str, name: str, stretch: int = 65_536) -> DataFrame:
    """``rows`` with the ``order`` value (a whole number) of the row before in the same group; null groups are one.

    A group may hold a third of all rows, so it's cut into stretches of ``order``
    that are sorted apart; the first row of a stretch takes the last value of the stretch before.
    """
    own, part, here, earlier = (free(x, rows) for x in ("_group", "_part", "_inside", "_before"))
    rows = rows.withColumn(own, F.struct(group.alias("g"))).withColumn(part, F.floor(F.col(order) / stretch))
    inside = F.lag(order).over(Window.partitionBy(own, part).orderBy(order))
    last = rows.groupBy(own, part).agg(F.max(order).alias("last"))
    before = last.select(own, part, F.lag("last").over(Window.partitionBy(own).orderBy(part)).alias(earlier))
    both = rows.withColumn(here, inside).join(before, [own, part], "left")
    return both.withColumn(name, F.coalesce(here, earlier)).drop(own, part, here, earlier)
