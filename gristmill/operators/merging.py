"""One record from several sources that link to each other, field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.graphs import chain_roots, kept


def node(source: str, key: Column) -> Column:
    """A record's name among those of all sources."""
    return F.concat(F.lit(f"{source}:"), key.cast("string"))


def identified(records: DataFrame, links: DataFrame) -> DataFrame:
    """``records`` (node, ...) with ``identity``, the smallest record they lead to by ``links`` (left, right), over any number of hops.

    Links with a side that isn't a record, or is null, link nothing.
    """
    known = records.select("node").distinct()
    real = links.join(known.withColumnRenamed("node", "left"), "left", "left_semi").join(known.withColumnRenamed("node", "right"), "right", "left_semi")
    roots = chain_roots(kept(real.where("left <> right").select("left", "right")), "left", "right")
    return records.join(roots, "node", "left").withColumn("identity", F.coalesce("root", "node")).drop("root")


def survived(records: DataFrame, fields: Sequence[str], rank: Mapping[str, Sequence[str]]) -> DataFrame:
    """identity, records, sources, ``fields``, conflicts: the record that is left of each identity.

    ``records`` have identity, node, source and the fields. Each field comes from the first
    source of its ``rank`` that has a value, ties by the smallest value; sources that aren't
    ranked come last. ``conflicts`` lists the fields that have different values.
    """
    aggregates = []
    for f in fields:
        order = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(rank[f])], F.lit(len(rank[f])))
        value = F.when(F.col(f).isNotNull(), F.struct(order.alias("rank"), F.col(f).alias("value")))
        aggregates += [F.min(value).alias(f"best_{f}"), F.min(f).alias(f"low_{f}"), F.max(f).alias(f"high_{f}")]
    whole = records.groupBy("identity").agg(F.count("*").alias("records"), F.array_sort(F.collect_set("source")).alias("sources"), *aggregates)
    several = F.array_compact(F.array(*[F.when(F.col(f"low_{f}") != F.col(f"high_{f}"), F.lit(f)) for f in fields]))
    return whole.select("identity", "records", "sources", *[F.col(f"best_{f}.value").alias(f) for f in fields], several.alias("conflicts"))


def cascade(register: DataFrame, known: DataFrame, key: str, name: Column, known_name: Column, other: str, known_other: str, relevant: Column, wanted: Column) -> DataFrame:
    """``register`` with ``state`` and ``linked``: what a full listing brings that isn't known yet.

    A listed row is 'known' by its key; else 'linked' by what another source calls it
    (``other``, ``known_other``); else 'renumbered' by a name that one known row has alone;
    a row that is none of these is 'irrelevant' unless ``relevant``, 'skipped' unless ``wanted``
    and else 'new'. ``linked`` is the key of the known row that was met, the smallest of several.
    """
    columns = list(register.columns)
    row = register.select(F.struct(*columns).alias("row"), F.col(key).alias("own_key"), name.alias("own_name"), F.col(other).alias("own_other"), relevant.alias("relevant"), wanted.alias("wanted"))
    by_key = known.select(F.col(key).alias("own_key"), F.col(key).alias("k1")).distinct()
    by_other = known.where(F.col(known_other).isNotNull()).groupBy(F.col(known_other).alias("own_other")).agg(F.min(key).alias("k2"))
    by_name = known.where(known_name.isNotNull()).groupBy(known_name.alias("own_name")).agg(F.min(key).alias("k3"), F.count("*").alias("n")).where("n = 1").drop("n")
    met = row.join(by_key, "own_key", "left").join(by_other, "own_other", "left").join(by_name, "own_name", "left")
    state = F.when(F.col("k1").isNotNull(), "known").when(F.col("k2").isNotNull(), "linked").when(F.col("k3").isNotNull(), "renumbered").when(~F.coalesce("relevant", F.lit(False)), "irrelevant").when(~F.coalesce("wanted", F.lit(False)), "skipped").otherwise("new")
    return met.select("row.*", state.alias("state"), F.coalesce("k1", "k2", "k3").alias("linked"))
