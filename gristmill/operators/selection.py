"""Which parts of a bundle are read, which texts are worth reading, and what must stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.decisions import first_rule
from gristmill.operators.graphs import kept


def selected(parts: DataFrame, bundle: Sequence[str], part: str, roles: Sequence[tuple[Column, str]], main: str, beside: str, rank: Sequence[Column], digest: Column, lost: Column) -> DataFrame:
    """bundle, state, chosen, annexes, rejected: the main part of each bundle and those that go with it.

    A part's role is the first of ``roles`` (condition, role). Of the ``main`` parts the least by
    ``rank`` is chosen; with several of one rank it is the smallest ``part`` if they are
    the same text, else the bundle is 'conflict' and nothing is chosen. ``beside`` parts are
    annexes, in order. A chosen part or annex that is ``lost`` in part makes the bundle 'waiting',
    no main part 'none'; else it is 'chosen'. ``rejected`` counts the other parts.
    """
    rows = parts.select(*bundle, F.col(part).alias("part"), first_rule(roles, "").alias("role"), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]).alias("rank"), digest.alias("digest"), F.coalesce(lost, F.lit(False)).alias("lost"))
    of = lambda role, x: F.when(F.col("role") == role, x)
    least = rows.groupBy(*bundle).agg(F.min(of(main, F.col("rank"))).alias("least"), F.count("*").alias("parts"))
    met = rows.join(least, list(bundle))
    best = (F.col("role") == main) & (F.col("rank") == F.col("least"))
    out = met.groupBy(*bundle).agg(
        F.first("parts").alias("parts"), F.min(F.when(best, F.struct("part", "lost"))).alias("best"), F.count_distinct(F.when(best, F.coalesce("digest", F.lit("")))).alias("texts"),
        F.array_sort(F.collect_list(of(beside, F.col("part")))).alias("annexes"), F.coalesce(F.max(of(beside, F.col("lost"))), F.lit(False)).alias("annex_lost"),
    )
    state = F.when(F.col("best").isNull(), "none").when(F.col("texts") > 1, "conflict").when(F.col("best.lost") | F.col("annex_lost"), "waiting").otherwise("chosen")
    out = out.withColumn("state", state)
    usable = F.col("state").isin("waiting", "chosen")
    annexes = F.when(usable, F.col("annexes")).otherwise(F.slice("annexes", 1, 0))
    return out.select(*bundle, "state", F.when(usable, F.col("best.part")).alias("chosen"), annexes.alias("annexes"), (F.col("parts") - usable.cast("int") - F.size(annexes)).alias("rejected"))


def carries_text(body: Column, pages: Column, least_chars: int, least_a_page: float) -> Column:
    """Whether a text is the document itself and no scrap around a scan: long enough, and for its pages too (0: not known)."""
    size = F.length(F.trim(F.coalesce(body, F.lit(""))))
    return (size >= least_chars) & ((F.coalesce(pages, F.lit(0)) <= 0) | (size / pages >= least_a_page))


def page_window(pages: Column, letter: Column) -> Column:
    """Struct (first, count) of the pages of a scan to read: all, but for a covering letter before others."""
    first = F.when(letter & (pages > 1), 1).otherwise(0)
    return F.struct(first.alias("first"), (pages - first).alias("count"))


def needed(uses: DataFrame, user: str, used: str, start: DataFrame, key: str) -> DataFrame:
    """``key``: all that ``start`` needs by ``uses``, itself included, over any number of steps.

    Each round follows the links of what the round before has found, so a link is
    followed once; cycles end. Rounds are checkpoints, as many as the longest way.
    """
    links = kept(uses.select(F.col(user).alias("user"), F.col(used).alias("used")).where("user is not null and used is not null").distinct())
    found = kept(start.select(F.col(key).alias("node")).where("node is not null").distinct())
    fresh = found
    while not fresh.isEmpty():
        fresh = kept(links.join(fresh, F.col("user") == F.col("node")).select(F.col("used").alias("node")).distinct().join(found, "node", "left_anti"))
        found = kept(found.union(fresh))
    return found.select(F.col("node").alias(key))


def prunable(payloads: DataFrame, key: str, old: Column, uses: DataFrame, user: str, used: str) -> DataFrame:
    """Rows of ``payloads`` that are ``old`` and that no row which stays needs, directly or through others."""
    stays = payloads.where(~F.coalesce(old, F.lit(False)))
    return payloads.where(old).join(needed(uses, user, used, stays, key), key, "left_anti")
