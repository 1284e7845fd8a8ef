"""Joins of a listing with what is known: cascades over keys, changed rows, groups, moved dates, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.names import free


def partners(rows: DataFrame, key: str, target: Column) -> DataFrame:
    """``rows`` with ``others``: how many other rows mean the same target.

    A row without a target of its own means itself, so the key is coalesced; one
    aggregation by it replaces the self join.
    """
    means = free("_target", rows)
    meant = rows.withColumn(means, F.coalesce(target, F.col(key)))
    sizes = meant.groupBy(means).agg((F.count("*") - 1).alias("others"))
    return meant.join(sizes, means).drop(means)


def first_of_each(left: DataFrame, right: DataFrame, facts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every combination of two small dimensions with the smallest ``value`` of its facts, or null.

    Only the keys are combined; the facts are reduced to one row a combination first.
    """
    least = facts.groupBy(*keys).agg(F.min(value).alias(value))
    return left.distinct().crossJoin(right.distinct()).join(least, list(keys), "left")


def whole_groups_of(rows: DataFrame, group: Sequence[str], chosen: Column) -> DataFrame:
    """All rows of the groups that hold a chosen row."""
    return rows.join(rows.where(chosen).select(*group).distinct(), list(group), "left_semi")


def revived(rows: DataFrame, group: Sequence[str], status: str, skipped: str, woken: str, by: Column) -> DataFrame:
    """``rows`` where skipped ones take the status ``woken`` if a row of their group meets ``by``."""
    wakes = free("_awake", rows)
    awake = rows.where(by).select(*group).distinct().withColumn(wakes, F.lit(True))
    new = F.when((F.col(status) == skipped) & F.col(wakes), woken).otherwise(F.col(status))
    return rows.join(awake, list(group), "left").withColumn(status, new).drop(wakes)


def discovered(register: DataFrame, known: DataFrame, key: str, name: Column, known_name: Column) -> DataFrame:
    """The register with ``state``: 'known' by its key, 'renumbered' by a name that one known row has alone, or 'new'."""
    by_key, n, own, called = (free(x, register) for x in ("_by_key", "_n", "_own", "_name"))
    keys = known.select(F.col(key), F.lit(True).alias(by_key)).distinct()
    names = known.groupBy(known_name.alias(called)).agg(F.count("*").alias(n)).where((F.col(n) == 1) & F.col(called).isNotNull())
    out = register.withColumn(own, name).join(keys, key, "left").join(names, F.col(own) == F.col(called), "left")
    state = F.when(F.col(by_key), "known").when(F.col(n) == 1, "renumbered").otherwise("new")
    return out.select(*register.columns, state.alias("state"))


def modified_since(listing: DataFrame, stored: DataFrame, key: str, modified: str, since: Column) -> DataFrame:
    """Listed rows that changed at or after ``since`` and are newer than what is stored, with ``state`` new or updated."""
    had = free("_stored", listing)
    before = stored.select(F.col(key), F.col(modified).alias(had))
    fresh = listing.where(F.col(modified) >= since).join(before, key, "left")
    changed = fresh.where(F.col(had).isNull() | (F.col(modified) > F.col(had)))
    return changed.withColumn("state", F.when(F.col(had).isNull(), "new").otherwise("updated")).drop(had)


def meetings(rows: DataFrame, listings: DataFrame, key: str, meeting: Sequence[str], order: Column) -> DataFrame:
    """``rows`` with the listings of their key; a meeting that is listed more than once counts by its first listing."""
    w = Window.partitionBy(key, *meeting).orderBy(order)
    nth = free("_nth", listings)
    once = listings.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)
    return rows.join(once, key)


def moved_from(rows: DataFrame, key: str, day: str, order: str, off: Column, within: int) -> DataFrame:
    """Rows that are on, with ``was``: the day of the row just before, if that was called off at most ``within`` days before."""
    w = Window.partitionBy(key).orderBy(day, order)
    before = F.lag(F.struct(F.col(day).alias("day"), off.alias("off"))).over(w)
    last = free("_before", rows)
    out = rows.withColumn(last, before).where(~off)
    near = F.datediff(F.col(day), F.col(f"{last}.day")) <= within
    return out.withColumn("was", F.when(F.col(f"{last}.off") & near, F.col(f"{last}.day"))).drop(last)


def linked_watches(watches: DataFrame, numbered: DataFrame, watch: str, number: str, name: Column, number_name: Column) -> DataFrame:
    """(watch, number): watched rows without a number and the one numbered row of their name; names that are not unique link nothing."""
    a = watches.groupBy(name.alias("_name")).agg(F.min(watch).alias(watch), F.count("*").alias("_n"))
    b = numbered.groupBy(number_name.alias("_name")).agg(F.min(number).alias(number), F.count("*").alias("_m"))
    return a.where("_n = 1").join(b.where("_m = 1"), "_name").select(watch, number)


def moved_owners(rows: DataFrame, owner: str, key: Sequence[str], old: object, new: object) -> DataFrame:
    """``rows`` where those of ``old`` go to ``new``, unless ``new`` has a row of the same key already."""
    mark = free("_taken", rows)
    taken = rows.where(F.col(owner) == new).select(*key).distinct().withColumn(mark, F.lit(True))
    out = rows.join(taken, list(key), "left")
    return out.withColumn(owner, F.when((F.col(owner) == old) & F.col(mark).isNull(), F.lit(new)).otherwise(F.col(owner))).select(*rows.columns)


def prunable(payloads: DataFrame, uses: DataFrame, key: str, made: str, before: Column) -> DataFrame:
    """Payloads made before a moment that nothing kept still needs."""
    return payloads.where(F.col(made) < before).join(uses.select(key).distinct(), key, "left_anti")
