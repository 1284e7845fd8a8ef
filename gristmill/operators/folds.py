"""Ordered folds, where each step depends on what the steps before decided.

``admitted`` and ``packed`` stream: a group's rows come sorted in one partition
and only a small state is carried on, so a group may be of any size, though one
task folds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def _streamed(rows: DataFrame, group: Sequence[str], order: str, amount: str) -> DataFrame:
    """group, _o, _x: each group in order, within one partition."""
    x = F.col(amount).cast("double")
    dealt = rows.select(*group, F.col(order).alias("_order"), x.alias("_x")).repartition(*group).sortWithinPartitions(*group, "_order", "_x")
    return dealt.select(*group, F.col("_order").cast("long").alias("_o"), "_x")


def folded(rows: DataFrame, n_keys: int, start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, Any]], name: str, kind: str) -> DataFrame:
    """Rows in their order with what ``step`` tells of each (None drops it); the state of a group goes on from batch to batch."""
    fields = rows.schema.fields
    schema = StructType([*fields, StructField(name, _parse_datatype_string(kind))])
    told = to_arrow_type(schema[name].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:n_keys]), strict=True)) if n_keys else [()] * batch.num_rows
            out = []
            for key, x in zip(keys, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if state is None or key != last:
                    last, state = key, start()
                state, value = step(state, x)
                out.append(value)
            new = pa.array(out, told)
            made = pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, name])
            yield made.filter(new.is_valid())

    return rows.mapInArrow(run, schema)


def ended(rows: DataFrame, n_keys: int, start: Callable[[], Any], step: Callable[[Any, Any], Any], end: Callable[[Any], Any], name: str, kind: str) -> DataFrame:
    """One row a group, of rows that lie group by group and in order: its keys and what ``end`` tells of the last state."""
    schema = StructType([*rows.schema.fields[:n_keys], StructField(name, _parse_datatype_string(kind))])
    told = to_arrow_type(schema[name].dataType)

    def made(keys: list[pa.Array], states: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*keys, pa.array([end(s) for s in states], told)], schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, state = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(c.to_pylist() for c in batch.columns[:n_keys]), strict=True))
            at, done = [], []
            for i, (key, x) in enumerate(zip(keys, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                if held is None or key != last:
                    if i and held is not None:
                        at.append(i - 1)
                        done.append(state)
                    elif held is not None:
                        yield made(held, [state])
                    held, last, state = (), key, start()
                state = step(state, x)
            if at:
                yield made([c.take(pa.array(at)) for c in batch.columns[:n_keys]], done)
            held = [c.slice(batch.num_rows - 1, 1) for c in batch.columns[:n_keys]]
        if held is not None:
            yield made(held, [state])

    return rows.mapInArrow(run, schema)


def admitted(rows: DataFrame, group: Sequence[str], order: str, amount: str, budget: float) -> DataFrame:
    """Items that a budget admits in order: one that doesn't fit is skipped, later ones may still fit."""

    def step(spent: float, x: float | None):
        return (spent + x, spent + x) if x is not None and spent + x <= budget else (spent, None)

    taken = folded(_streamed(rows, group, order, amount), len(group), lambda: 0.0, step, "_spent", "double").withColumn("_at", F.monotonically_increasing_id())
    # backwards, a group's first row tells what was spent in all; rows are where they were, so nothing is dealt again
    back = taken.sortWithinPartitions(F.desc("_at")).select(*group, "_o", "_x", "_spent")
    whole = folded(back, len(group), lambda: (), lambda s, x: (s or (x,), (s or (x,))[0]), "spent", "double")
    return whole.select(*group, "spent", F.col("_o").alias(order), F.col("_x").alias(amount))


def packed(rows: DataFrame, group: Sequence[str], order: str, amount: str, most: float, most_items: int) -> DataFrame:
    """Consecutive batches in order, none over ``most`` or ``most_items`` (a larger item is alone)."""

    def step(state: tuple[int, float | None, int], x: float | None):
        batch, total, n = state
        now = None if x is None or total is None else total + x
        # nan counts as more than any number, a null sum as not over
        if n and (n >= most_items or (now is not None and not now <= most)):
            return (batch + 1, x, 1), batch + 1
        return (batch, now, n + 1), batch

    out = folded(_streamed(rows, group, order, amount), len(group), lambda: (0, 0.0, 0), step, "batch", "int")
    return out.select(*group, F.col("_o").alias(order), F.col("_x").alias(amount), "batch")


def packed_with_references(rows: DataFrame, group: Sequence[str], order: str, size: str, references: str, most: float) -> DataFrame:
    """group, order, batch, added: units in order, each with the units it refers to, in batches of at most ``most``.

    ``order`` is a whole number that names a unit in its group; ``references`` lists
    structs (id, size). What a batch holds already isn't added again. A unit
    that is too large even alone with its references opens a batch, and ``added`` tells.
    """
    unit = F.struct(F.col(order).cast("long").alias("id"), F.col(size).cast("double").alias("size"), F.col(references).alias("references"))
    dealt = rows.select(*group, F.col(order).cast("long").alias(order), unit.alias("_x")).repartition(*group).sortWithinPartitions(*group, order)

    def step(state: tuple[int, set[int], float], x: dict):
        batch, held, used = state
        needed = {r["id"]: r["size"] for r in x["references"] or []} | {x["id"]: x["size"] or 0.0}
        added = sum(n for k, n in needed.items() if k not in held)
        if held and used + added > most:
            batch, held, used, added = batch + 1, set(), 0.0, sum(needed.values())
        return (batch, held | needed.keys(), used + added), {"batch": batch, "added": added}

    out = folded(dealt, len(group), lambda: (0, set(), 0.0), step, "_b", "struct<batch:int,added:double>")
    return out.select(*group, order, "_b.batch", "_b.added")


def bundled(rows: DataFrame, group: Sequence[str], at: str, most: float) -> DataFrame:
    """``rows`` with ``bundle``, from 0 in each group: a bundle is closed by the first row more than ``most`` after its first.

    Rows without a moment are left out; ties go by the other columns.
    """
    others = [c for c in rows.columns if c not in group and c != at]
    dealt = rows.where(F.col(at).isNotNull()).select(*group, *others, at).repartition(*group).sortWithinPartitions(*group, at, *others)

    def step(state: tuple[float | None, int], x: float):
        first, n = state
        if first is None:
            return (x, 0), 0
        return ((x, n + 1), n + 1) if x - first > most else (state, n)

    return folded(dealt, len(group), lambda: (None, 0), step, "bundle", "int")


def barrier_groups(rows: DataFrame, group: Sequence[str], order: str, barrier: Column, most: int) -> DataFrame:
    """Runs between barriers, cut after ``most`` rows; a barrier row is a group of its own."""
    w = Window.partitionBy(*group).orderBy(order)
    here = F.coalesce(barrier, F.lit(False)).cast("int")
    marked = rows.withColumn("_b", F.sum(here).over(w) * 2 - here)
    run = Window.partitionBy(*group, "_b").orderBy(order)
    return marked.withColumn("chunk", F.floor((F.row_number().over(run) - 1) / most)).withColumnRenamed("_b", "run")


def held_until(rows: DataFrame, group: Sequence[str], order: str, releases: Column, name: str) -> DataFrame:
    """Each row with the next row at or after it that releases it (null while none has come)."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(name, F.min(F.when(releases, F.col(order))).over(w))
