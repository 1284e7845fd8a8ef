"""Running values along keys of any size.

A window function brings each key to one task. Here rows are sorted by ranges
of (key, order), so a key may span partitions; each partition runs on its own,
and what it must start from is worked out afterwards from one row a key and
partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gristmill.llm.common import stored

PART, PLACE = "scan_part", "scan_place"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class _Runs:
    """Where runs of one key begin in a batch, and whether the first goes on from the batch before."""

    def __init__(self):
        self.last = None

    def of(self, key: pa.Array) -> tuple[np.ndarray, np.ndarray, bool]:
        n = len(key)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        on = self.last is not None and self.last == key[0].as_py()
        self.last = key[n - 1].as_py()
        begin = np.flatnonzero(new)
        return begin, np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n))), on


def _taken(column: pa.Array, index: np.ndarray, before: pa.Scalar | None) -> pa.Array:
    """column[index]; an index of -1 gives null, -2 gives ``before``."""
    if before is not None:
        column = pa.concat_arrays([column, pa.array([before.as_py()], column.type)])
    at = np.where(index == -2, len(column) - 1 if before is not None else -1, index)
    return column.take(pa.array(at, mask=at < 0))


def running(
    df: DataFrame,
    key: str,
    order: Sequence[Column],
    *,
    sums: Sequence[str] = (),
    xors: Sequence[str] = (),
    fills: Sequence[str] = (),
    previous: Sequence[str] = (),
    per_key: DataFrame | None = None,
    name: str = "scan",
) -> DataFrame:
    """``df`` with running values along ``order`` within ``key`` (a column without nulls).

    Adds ``place`` (from 1) and ``rows`` (of the key). A column x of ``sums`` or
    ``xors`` becomes ``running_x`` (itself included) and ``total_x``; of ``fills``
    ``filled_x``, the latest value that isn't null, itself included; of
    ``previous`` ``previous_x``, the value of the row before. ``per_key`` (a row a
    key) is joined where keys are few rows, so a hot key doesn't matter.

    ``order`` has to tell rows apart, or the rows it leaves tied have to be alike.
    Names that start with ``scan_`` are taken.
    """
    n, ordered = partitions(df), [F.col(key).asc(), *order]
    dealt = df.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered)
    at = {c: df.columns.index(c) for c in (key, *sums, *xors, *fills, *previous)}
    schema = StructType([*df.schema.fields, StructField(PART, LongType()), StructField(PLACE, LongType())])
    for c in (*sums, *xors):
        schema = schema.add(f"scan_r_{c}", LongType())
    for c in (*fills, *previous):
        schema = schema.add(StructField(f"scan_f_{c}" if c in fills else f"scan_p_{c}", df.schema[c].dataType))

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs, carry, place, held = TaskContext.get().partitionId(), _Runs(), {}, 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            begin, run, on = runs.of(batch.column(at[key]))
            places = np.arange(rows) - begin[run] + 1
            places[run == 0] += place if on else 0
            place = int(places[-1])
            out = [*batch.columns, pa.array(np.full(rows, part, np.int64)), pa.array(places)]
            for c in (*sums, *xors):
                x = batch.column(at[c]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if c in sums:
                    got = np.cumsum(x)
                    got -= (got[begin] - x[begin])[run]
                    got[run == 0] += carry.get(c, 0) if on else 0
                else:
                    got = np.bitwise_xor.accumulate(x)
                    got ^= (got[begin] ^ x[begin])[run]
                    got[run == 0] ^= carry.get(c, 0) if on else 0
                carry[c] = int(got[-1])
                out.append(pa.array(got))
            for c in (*fills, *previous):
                column = batch.column(at[c])
                if c in fills:
                    index = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(rows), -1))
                else:
                    index = np.arange(rows) - 1
                index = np.where(index < begin[run], np.where((run == 0) & on, -2, -1), index)
                got = _taken(column, index, held.get(c) if on else None)
                held[c] = got[rows - 1] if c in fills else column[rows - 1]
                out.append(got)
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    rows = stored(dealt.mapInArrow(local, schema), f"{name}-rows")
    last = [F.max(PLACE).alias("scan_n")]
    last += [F.max_by(f"scan_r_{c}", PLACE).alias(f"scan_last_{c}") for c in (*sums, *xors)]
    last += [F.max_by(f"scan_f_{c}", PLACE).alias(f"scan_fill_{c}") for c in fills]
    last += [F.max_by(c, PLACE).alias(f"scan_prev_{c}") for c in previous]
    # a row a key and partition: a hot key has as many as there are partitions
    parts = rows.groupBy(key, PART).agg(*last)
    whole = Window.partitionBy(key)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    found = [F.coalesce(F.sum("scan_n").over(before), F.lit(0)).alias("scan_b"), F.sum("scan_n").over(whole).alias("rows")]
    for c in sums:
        found += [F.coalesce(F.sum(f"scan_last_{c}").over(before), F.lit(0)).alias(f"scan_b_{c}"), F.sum(f"scan_last_{c}").over(whole).alias(f"total_{c}")]
    for c in xors:
        found += [F.coalesce(F.bit_xor(f"scan_last_{c}").over(before), F.lit(0)).alias(f"scan_b_{c}"), F.bit_xor(f"scan_last_{c}").over(whole).alias(f"total_{c}")]
    found += [F.last(f"scan_fill_{c}", ignorenulls=True).over(before).alias(f"scan_bf_{c}") for c in fills]
    found += [F.last(f"scan_prev_{c}").over(before).alias(f"scan_bp_{c}") for c in previous]
    carries = parts.select(key, PART, *found)
    if per_key is not None:
        carries = carries.join(per_key, key, "left")
    extra = [c for c in per_key.columns if c != key] if per_key is not None else []
    first = F.col(PLACE) == 1
    return rows.join(stored(carries, f"{name}-carries"), [key, PART]).select(
        *[F.col(c) for c in df.columns],
        (F.col(PLACE) + F.col("scan_b")).alias("place"),
        "rows",
        *[(F.col(f"scan_r_{c}") + F.col(f"scan_b_{c}")).alias(f"running_{c}") for c in sums],
        *[F.col(f"scan_r_{c}").bitwiseXOR(F.col(f"scan_b_{c}")).alias(f"running_{c}") for c in xors],
        *[F.col(f"total_{c}") for c in (*sums, *xors)],
        *[F.coalesce(f"scan_f_{c}", f"scan_bf_{c}").alias(f"filled_{c}") for c in fills],
        *[F.when(first, F.col(f"scan_bp_{c}")).otherwise(F.col(f"scan_p_{c}")).alias(f"previous_{c}") for c in previous],
        *extra,
    )
