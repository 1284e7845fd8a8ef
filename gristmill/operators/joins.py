"""Joins beyond plain equality: fallback keys, longest prefixes, first match, newest at or after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.names import free


def with_existence(rows: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``rows`` with a boolean: whether ``other`` has the key."""
    have = other.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(have, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_match(groups: DataFrame, members: str, rows: DataFrame, key: str, condition: Column, group_keys: Sequence[str]) -> DataFrame:
    """For each group, the first of its listed members that meets the condition."""
    listed = groups.select(*group_keys, F.posexplode(members).alias("pos", key))
    return listed.join(rows.where(condition), key).groupBy(*group_keys).agg(F.min_by(key, "pos").alias("first_member"), F.min("pos").alias("first_pos"))


def newest_not_before(rows: DataFrame, candidates: DataFrame, key: str, moment: str, made: str, value: str) -> DataFrame:
    """``rows`` with the newest candidate of the same key made at or after the row's moment.

    That is the key's newest candidate of all, or none: one row a key meets the rows.
    """
    own, found = free("_key", rows), free("_last", rows)
    last = candidates.groupBy(F.col(key).alias(own)).agg(F.max(F.struct(F.col(made).alias("made"), F.col(value).alias("value"))).alias(found))
    newest = F.when(F.col(f"{found}.made") >= rows[moment], F.col(f"{found}.value"))
    return rows.join(last, rows[key] == F.col(own), "left").select(*[rows[c] for c in rows.columns], newest.alias("newest"))


def by_fallback_keys(rows: DataFrame, dim: DataFrame, name: str, keys: Sequence[tuple[str, Column, Column]], value: str) -> DataFrame:
    """Look ``name`` up by several keys in turn: ``value`` and which key found it.

    A key that more than one row of ``dim`` shares finds nothing by that key.
    """
    out, found, how = rows, F.lit(None), F.lit(None)
    for label, of_row, of_dim in reversed(keys):
        one = dim.select(of_dim.alias(f"_k_{label}"), F.col(value).alias("_v")).groupBy(f"_k_{label}").agg(F.min("_v").alias(f"_v_{label}"), F.count("*").alias(f"_n_{label}")).where(f"_n_{label} = 1")
        out = out.join(one, of_row == F.col(f"_k_{label}"), "left")
        found = F.coalesce(F.col(f"_v_{label}"), found)
        how = F.when(F.col(f"_v_{label}").isNotNull(), label).otherwise(how)
    return out.select(*rows.columns, found.alias("found"), how.alias("found_by"))


def by_longest_prefix(rows: DataFrame, name: str, table: DataFrame, prefix: str, lengths: Sequence[int]) -> DataFrame:
    """``rows`` joined to the row of ``table`` with the longest prefix of ``name``.

    ``lengths`` are the lengths that prefixes have: one equality join for all of
    them, in place of a join on startswith, which would compare all pairs.
    """
    own = free("_name", rows, table)
    names = rows.select(F.col(name).alias(own)).distinct()
    tries = names.select(own, F.explode(F.array_distinct(F.array(*[F.substring(own, 1, n) for n in lengths]))).alias("try"))
    best = tries.join(table.select(F.col(prefix).alias("try")), "try").groupBy(own).agg(F.max_by("try", F.length("try")).alias(prefix))
    return rows.join(best, rows[name] == F.col(own), "left").drop(own).join(table, prefix, "left")


def sharing_any(left: DataFrame, right: DataFrame, left_key: str, left_set: str, right_key: str, right_set: str) -> DataFrame:
    """Pairs whose sets share a value, with how many."""
    a = left.select(left_key, F.explode(F.array_distinct(left_set)).alias("_x"))
    b = right.select(right_key, F.explode(F.array_distinct(right_set)).alias("_x"))
    return a.join(b, "_x").groupBy(left_key, right_key).agg(F.count("*").alias("shared"))


#: Words that a key of :func:`containing` has at most; items without one that are looked for at once.
KEY_WORDS = 4
SHORT_ITEMS = 200


def containing(docs: DataFrame, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(item, n_docs): how many rows of ``docs`` hold each item's text as a part, character by character.

    The first and last words of an item may be parts of a document's words, but
    those between are whole, so up to ``KEY_WORDS`` of them are its key. One pass
    over a document gives its runs of so many words, hashed; only documents that
    share a key are looked at again. Items of less than three words have no such
    key; they are looked for in every document. Null texts hold nothing, null items
    are held by nothing, and an empty item by every text.
    """
    docs = docs.select(F.col(text).alias("_text")).where("_text is not null").withColumn("_row", F.xxhash64("_text"))
    texts = docs.groupBy("_row", "_text").agg(F.count("*").alias("_n"))
    words = F.filter(F.split("_item", r"\s+"), lambda w: w != "")
    held = items.select(F.col(item).alias("_id"), F.col(item_text).alias("_item")).withColumn("_words", words)
    held = held.withColumn("_size", F.least(F.size("_words") - 2, F.lit(KEY_WORDS)))
    sizes = sorted(r[0] for r in held.where("_item is not null").select("_size").distinct().collect())
    key = F.xxhash64("_size", F.array_join(F.expr("slice(_words, 2, greatest(_size, 0))"), " "))
    hits = held.limit(0).select("_id", F.lit(0).cast("long").alias("_row"))
    if any(n < 1 for n in sizes):
        # items without a key are looked for in blocks, one list of them beside each text
        short = held.where("_size < 1 and _item is not null").select(F.struct("_id", "_item").alias("one"), F.floor(F.monotonically_increasing_id() / SHORT_ITEMS).alias("block"))
        for block in short.groupBy("block").agg(F.collect_list("one").alias("some")).select("some").toLocalIterator():
            listed = F.array(*[F.struct(F.lit(x["_id"]).alias("_id"), F.lit(x["_item"]).alias("_item")) for x in block["some"]])
            hits = hits.union(texts.select("_row", F.explode(F.filter(listed, lambda x: F.contains(F.col("_text"), x["_item"]))).alias("x")).select("x._id", "_row"))
    for k in (n for n in sizes if n > 0):
        some = held.where(F.col("_size") == k).select("_id", "_item", key.alias("_key"))
        run = rf"(?<!\S)(?=(\S+(?:\s+\S+){{{k - 1}}}))"
        grams = docs.select("_row", F.explode(F.regexp_extract_all("_text", F.lit(run), F.lit(1))).alias("_gram"))
        grams = grams.select("_row", F.xxhash64(F.lit(k), F.regexp_replace("_gram", r"\s+", " ")).alias("_key"))
        maybe = grams.join(some, "_key").select("_row", "_id", "_item").distinct()
        hits = hits.union(maybe.join(texts, "_row").where(F.contains("_text", "_item")).select("_id", "_row"))
    counts = hits.join(texts.select("_row", "_n"), "_row").groupBy("_id").agg(F.sum("_n").alias("n_docs"))
    found = counts.select(F.col("_id").alias(item), "n_docs")
    return items.select(item).join(found, item, "left").select(item, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
