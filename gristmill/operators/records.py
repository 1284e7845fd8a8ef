"""Records of a JSON listing as typed rows: votes, attachments and plain lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.json_trees import tree_rows

VOTING = "struct<votes:array<struct<MP:bigint,club:string,vote:string>>,links:array<struct<rel:string,href:string>>>"
COUNTED = {"yes": "YES", "no": "NO", "abstain": "ABSTAIN"}


def club_votes(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, club, yes, no, abstain, absent, pdf: a voting's votes by club; a missing club is blank, any other vote counts as absent.

    ``pdf`` is the first link of that kind. A voting without votes, or a text that
    isn't one, has no rows.
    """
    read = texts.select(F.struct(*keys).alias("owner"), F.from_json(text, VOTING).alias("v"))
    pdf = F.get(F.filter("v.links", lambda x: x["rel"] == "pdf"), F.lit(0))["href"]
    votes = read.select("owner", pdf.alias("pdf"), F.explode("v.votes").alias("x")).select("owner", "pdf", F.coalesce("x.club", F.lit("")).alias("club"), F.coalesce("x.vote", F.lit("")).alias("vote"))
    counts = [F.count_if(F.col("vote") == v).alias(n) for n, v in COUNTED.items()]
    return votes.groupBy("owner", "club").agg(*counts, F.count_if(~F.col("vote").isin(*COUNTED.values())).alias("absent"), F.first("pdf").alias("pdf")).select("owner.*", "club", *COUNTED, "absent", "pdf")


def attachments(texts: DataFrame, keys: Sequence[str], text: str, base: str) -> DataFrame:
    """keys, number, title, depth, attachment, url: the files of prints and of their additional prints, at any depth."""
    fields = {"number": ("$.number", "string"), "title": ("$.title", "string"), "attachments": ("$.attachments", "array<string>")}
    prints = tree_rows(texts, keys, text, "$.prints", "$.additionalPrints", fields)
    files = prints.select(*keys, "number", F.trim("title").alias("title"), (F.size("path") - 1).alias("depth"), F.explode("attachments").alias("attachment"))
    return files.withColumn("url", F.concat(F.lit(f"{base}/"), F.url_encode("number"), F.lit("/"), F.url_encode("attachment")))


def listed(texts: DataFrame, text: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """A row for each record of a JSON list: name -> (field, type); a value of another kind is null."""
    read = texts.select(F.explode(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")).alias("x"))
    return read.select(*[F.try_variant_get("x", f"$.{f}", kind).alias(n) for n, (f, kind) in fields.items()])
