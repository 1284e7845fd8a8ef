"""Row numbers and neighbours along keys of any size, where a window would bring each key to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.graphs import kept
from gristmill.operators.names import free

#: A key is cut into so many stretches at most.
MOST_STRETCHES = 256


def numbered(rows: DataFrame, key: str, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place in ``order`` within ``key``, from 0; ``order`` has to tell rows of a key apart.

    Rows are sorted by ranges of (key, order). A key and partition is one row of
    counts, so a hot key adds as many rows as there are partitions. A null key is a key.
    """
    at, part, first, before, own = (free(f"_{x}", rows) for x in ("at", "part", "first", "before", "own"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    dealt = kept(dealt.withColumn(part, F.shiftright(at, 33)))
    counts = dealt.groupBy(F.col(key).alias(own), part).agg(F.min(at).alias(first), F.count("*").alias(before))
    w = Window.partitionBy(own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(own, F.col(part).alias(f"{part}_"), first, F.coalesce(F.sum(before).over(w), F.lit(0)).alias(before))
    met = dealt[key].eqNullSafe(counts[own]) & (dealt[part] == counts[f"{part}_"])
    place = (F.col(at) - F.col(first) + F.col(before)).alias(name)
    return dealt.join(counts, met).select(*[dealt[c] for c in rows.columns], place)


def stretches(rows: DataFrame, key: str, order: str, name: str, carried: str, most: int = 1_000) -> DataFrame:
    """``rows`` with the number of their stretch of ``key``, so that neighbours in ``order`` (a whole number) meet in one.

    Keys of more than ``most`` rows are cut at quantiles of ``order`` into stretches of
    about that many, ``MOST_STRETCHES`` at most; a quantile may be off without harm. The
    last row of a stretch also opens the key's next one, where ``carried`` is true. What
    is cut is broadcast, one row for ``most`` rows at most; ``key`` and ``order`` are not null.
    """
    cuts, size, last, other, to, dealt = (free(x, rows) for x in ("_cuts", "_size", "_last", "_other", "_to", "_dealt"))
    own = kept(rows.select(key, order))
    large = own.groupBy(key).agg(F.count("*").alias(size)).where(F.col(size) > most)
    found = F.percentile_approx(order, [i / MOST_STRETCHES for i in range(1, MOST_STRETCHES)], 10 * MOST_STRETCHES)
    n = F.least(F.ceil(F.col(size) / most), F.lit(MOST_STRETCHES))
    even = own.join(F.broadcast(large), key).groupBy(key, size).agg(found.alias(cuts))
    # quantiles aren't the same each time they are worked out, so they are kept
    cut = kept(even.select(key, F.filter(cuts, lambda _, i: (i + 1) * n % MOST_STRETCHES < n).alias(cuts)))
    part = F.size(F.filter(cuts, lambda c: c < F.col(order))).cast("long")
    ends = own.join(F.broadcast(cut), key).groupBy(key, part.alias(name)).agg(F.max(order).alias(last))
    following = F.lead(name).over(Window.partitionBy(key).orderBy(name))
    ends = ends.select(F.col(key).alias(other), last, following.alias(to)).where(F.col(to).isNotNull())
    here = lambda c, again: F.struct(c.alias("n"), F.lit(again).alias("again"))
    first = here(F.when(F.col(cuts).isNull(), 0).otherwise(part).cast("long"), False)
    both = F.when(F.col(to).isNull(), F.array(first)).otherwise(F.array(first, here(F.col(to), True)))
    met = rows.join(F.broadcast(cut), key, "left").join(F.broadcast(ends), (F.col(key) == F.col(other)) & (F.col(order) == F.col(last)), "left")
    return met.select(*rows.columns, F.explode(both).alias(dealt)).select(*rows.columns, F.col(f"{dealt}.n").alias(name), F.col(f"{dealt}.again").alias(carried))
