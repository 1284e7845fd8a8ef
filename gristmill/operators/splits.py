"""Splits of a corpus that keep linked rows together, and the proof that they do."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.graphs import chain_roots, kept
from gristmill.operators.places import numbered


def dealt_out(sizes: Sequence[tuple[int, int]], shares: Sequence[float]) -> list[tuple[int, list[int]]]:
    """How many groups of each size go to each split: (size, number of groups), largest first, each to the split that is emptiest for its share.

    The groups of one size are those with the smallest fillings that the splits
    run through, so a bisection deals nearly all of them at once: the work follows
    the different sizes and not the groups.
    """
    filled, out = [0] * len(shares), []
    for size, count in sorted(sizes, reverse=True):

        def up_to(level: float, size: int = size) -> list[int]:
            return [math.floor((level * s - f) / size) + 1 if level * s >= f else 0 for f, s in zip(filled, shares, strict=True)]

        low, high = -1.0, (max(filled) + count * size) / min(shares) + 1
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(up_to(middle)) <= count else (low, middle)
        got = up_to(low)
        for _ in range(count - sum(got)):
            k = min(range(len(shares)), key=lambda k: ((filled[k] + got[k] * size) / shares[k], k))
            got[k] += 1
        filled = [f + g * size for f, g in zip(filled, got, strict=True)]
        out.append((size, got))
    return out


def grouped(rows: DataFrame, key: str, links: Sequence[Column]) -> DataFrame:
    """``key``, root: rows that share the value of any of ``links`` are one group, also through others; null values link nothing."""
    values = rows.select(key, F.explode(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{i}="), v.cast("string"))) for i, v in enumerate(links)])).alias("value")).where("value is not null")
    # a star to the smallest row of each value: as many links as values, not pairs
    least = values.groupBy("value").agg(F.min(key).alias("least"))
    edges = values.join(least, "value").where(F.col(key) != F.col("least")).select(key, "least")
    roots = chain_roots(edges, key, "least").select(F.col("node").alias(key), "root")
    return rows.select(key).join(roots, key, "left").select(key, F.coalesce("root", key).alias("root"))


def split(groups: DataFrame, key: str, root: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """``key``, root, split: whole groups dealt to splits by their shares, the largest first to the emptiest.

    The driver holds a row for each different size of a group, of which n rows have at
    most the root of 2n.
    """
    sizes = kept(groups.groupBy(root).agg(F.count("*").alias("size")))
    counts = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()]
    table, names = [], [n for n, _ in shares]
    for size, got in dealt_out(counts, [s for _, s in shares]):
        end = 0
        for n, took in zip(names, got, strict=True):
            if took:
                table.append((size, end, end + took, n))
                end += took
    spark = groups.sparkSession
    dealt = spark.createDataFrame(table, "size long, from long, to long, split string")
    placed = numbered(sizes, "size", [F.col(root)])
    told = placed.join(F.broadcast(dealt), "size").where("place >= from and place < to").select(root, "split")
    return groups.join(told, root).select(key, root, "split")


def leaks(rows: DataFrame, key: Sequence[str], split_col: str) -> DataFrame:
    """key, splits: values that stand in more than one split; empty if none leaks."""
    found = rows.groupBy(*key).agg(F.count_distinct(split_col).alias("splits"))
    return found.where("splits > 1")
