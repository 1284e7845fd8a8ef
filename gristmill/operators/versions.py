"""Versions of one text told apart by their content, however they carry their notes.

A note stands either in the text, in brackets after a word, or as a numbered line
with a mark behind the word. What notes a group's texts hold is found once a group;
then each text has its notes put in place of their marks by a digest, and equal
texts are one identity. Words count, not spacing, case or punctuation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A note in the text: its first group is what it says.
INLINE = r"\(note:\s*([^()]+)\)"
#: A note as a line of its own: number and what it says.
FOOT = r"(?m)^[ \t]*(\d{1,2})\)[ \t]*(\S[^\n]*)$"


def _key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def _token(note: Column) -> Column:
    return F.concat(F.lit(" note"), F.sha2(_key(note), 256), F.lit(" "))


def identities(texts: DataFrame, group: Sequence[str], key: str, text: str) -> DataFrame:
    """group, ``key``, identity, notes: a text's identity within its group, and how many notes it holds.

    A numbered line is a note only if another text of the group has the same
    note in brackets; a text that has bracketed notes has no other ones. Null texts
    are empty.
    """
    held = texts.select(F.struct(*group).alias("owner"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    inline = F.regexp_extract_all("text", F.lit(INLINE), F.lit(1))
    known = held.select("owner", F.explode(F.transform(inline, _key)).alias("note")).groupBy("owner").agg(F.collect_set("note").alias("known"))
    held = held.join(known, "owner", "left").withColumn("own", F.size(inline))
    feet = F.arrays_zip(F.regexp_extract_all("text", F.lit(FOOT), F.lit(1)).alias("mark"), F.regexp_extract_all("text", F.lit(FOOT), F.lit(2)).alias("note"))
    feet = F.filter(feet, lambda f: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), _key(f["note"])))
    held = held.withColumn("feet", F.when(F.col("own") == 0, feet).otherwise(F.array().cast("array<struct<mark:string,note:string>>")))
    # bracketed notes become their digests, one after another
    parts, hits = F.split("text", INLINE, -1), F.regexp_extract_all("text", F.lit(INLINE), F.lit(1))
    bracketed = F.array_join(F.flatten(F.transform(parts, lambda p, i: F.array(p, F.coalesce(_token(F.get(hits, i)), F.lit(""))))), "")

    def placed(found: Column, foot: Column) -> Column:
        line = F.concat(F.lit(r"(?m)^[ \t]*"), foot["mark"], F.lit(r"\)[ \t]*\Q"), foot["note"], F.lit(r"\E$"))
        mark = F.concat(F.lit(r"(?<=[\p{L}.])"), foot["mark"], F.lit(r"\)"))
        return F.regexp_replace(F.regexp_replace(found, line, F.lit("")), mark, _token(foot["note"]))

    canonical = F.aggregate("feet", bracketed, placed)
    told = held.withColumn("canonical", canonical)
    return told.select("owner.*", F.col("key").alias(key), F.sha2(_key(F.col("canonical")), 256).alias("identity"), (F.col("own") + F.size("feet")).alias("notes"))


def compared(texts: DataFrame, group: Sequence[str], key: str, text: str, subject: Column, made: Column) -> DataFrame:
    """group, members, considered, identities, same, by_date: whether a group's texts are one version.

    If all members have one subject and a date, only those of the latest date are
    considered; a date that one lacks counts for none. ``same`` holds if those
    considered have one identity.
    """
    own = texts.select(*group, F.col(key), subject.alias("subject"), made.alias("made"))
    whole = own.groupBy(*group).agg(
        F.count("*").alias("members"), F.count("made").alias("dated"), F.max("made").alias("latest"), F.count_distinct(F.coalesce("subject", F.lit(""))).alias("subjects"), F.min(F.coalesce("subject", F.lit(""))).alias("least")
    )
    dated = (F.col("dated") == F.col("members")) & (F.col("subjects") == 1) & (F.col("least") != "")
    whole = whole.select(*group, "members", F.when(dated, F.col("latest")).alias("latest"))
    rows = identities(texts, group, key, text).join(own.select(*group, key, "made"), [*group, key]).join(whole, list(group))
    considered = F.col("latest").isNull() | (F.col("made") == F.col("latest"))
    out = rows.groupBy(*group).agg(F.first("members").alias("members"), F.count_if(considered).alias("considered"), F.count_distinct(F.when(considered, F.col("identity"))).alias("identities"))
    return out.select(*group, "members", "considered", "identities", (F.col("identities") == 1).alias("same"), (F.col("considered") < F.col("members")).alias("by_date"))
