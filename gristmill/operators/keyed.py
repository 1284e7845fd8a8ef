"""Keyed tables: upserts, append-if-absent, latest rows, duplicates by content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.graphs import kept
from gristmill.operators.names import free


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = (), immutable: Sequence[str] = ()) -> DataFrame:
    """``new`` over ``old`` by key.

    New values replace old ones, except that a null never replaces a value in
    ``keep_if_null`` and columns in ``immutable`` stay as first seen.
    """
    was, comes = free("_old", old, new), free("_new", old, new)
    n = new.withColumn(comes, F.lit(True)).alias("n")
    both = old.withColumn(was, F.lit(True)).alias("o").join(n, list(keys), "full_outer")
    values = [c for c in old.columns if c not in keys]

    def value(c: str) -> Column:
        o, x = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in immutable:
            return F.when(F.col(was), o).otherwise(x).alias(c)
        if c in keep_if_null:
            return F.coalesce(x, o).alias(c)
        return F.when(F.col(comes), x).otherwise(o).alias(c)

    return both.select(*keys, *[value(c) for c in values])


def insert_if_absent(table: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``new`` whose key isn't in ``table``; of several with one key the first by ``order``."""
    return first_per_key(new.join(table.select(*keys).distinct(), list(keys), "left_anti"), keys, order)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first by ``order``. End ``order`` with a unique column to break ties."""
    rank = free("_rank", rows)
    ranked = rows.select("*", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias(rank))
    return ranked.where(F.col(rank) == 1).drop(rank)


def duplicates_by(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """Each row with ``first_id``, the smallest ``order`` of equal content, and ``copies``.

    The counts are added up before the shuffle and joined back. Where the joined
    rows are shuffled, a content with very many copies is one key: adaptive execution
    splits it, as the counts are a table of their own.
    """
    held = rows.withColumn("content", content)
    groups = kept(held.groupBy("content").agg(F.min(order).alias("first_id"), F.count("*").alias("copies")))
    return held.join(groups, "content")


def conflicts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that hold more than one value; empty if the key determines it."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def linked_both_ways(rows: DataFrame, links: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``rows`` with ``linked``: the partner of a link, whichever side of it the row is on."""
    pairs = links.select(F.col(left).alias(key), F.col(right).alias("linked")).union(links.select(F.col(right), F.col(left)))
    return rows.join(pairs.groupBy(key).agg(F.min("linked").alias("linked")), key, "left")


def compared(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, state: what became of each key from one version to the next: new, gone, changed or unchanged."""
    o, n = (x.select(*keys, F.col(value).alias(name), F.lit(True).alias(f"{name}_has")) for x, name in ((old, "_was"), (new, "_is")))
    both = o.join(n, list(keys), "full_outer")
    kept = F.when(F.col("_was").eqNullSafe(F.col("_is")), "unchanged").otherwise("changed")
    return both.select(*keys, F.when(F.col("_is_has").isNull(), "gone").when(F.col("_was_has").isNull(), "new").otherwise(kept).alias("state"))


def looked_up(rows: DataFrame, key: Mapping[str, object]) -> DataFrame:
    """The rows of one key; equality on columns, so it is pushed to the scan. A null looks up nulls."""
    for c, v in key.items():
        rows = rows.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    return rows
