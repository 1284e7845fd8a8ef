"""The cascade that decides which documents are read: cheap tests first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import enough_hits, keyword_counts, keyword_hits, strong_hit


def prefiltered(docs: DataFrame, title: str, text: str, patterns: Mapping[str, str], weak: Sequence[str], least_chars: int = 200) -> DataFrame:
    """``docs`` with ``decision``: by title, by text, too short to tell, or rejected.

    Titles are looked at first; a text is only searched where its title didn't
    decide, since CASE branches are evaluated in order.
    """
    by_title = strong_hit(keyword_hits(F.col(title), patterns), weak)
    by_text = enough_hits(keyword_counts(F.col(text), patterns), weak)
    decision = F.when(by_title, "title").when(F.length(F.coalesce(text, F.lit(""))) < least_chars, "short").when(by_text, "text").otherwise("rejected")
    return docs.withColumn("decision", decision)


def accept_rates(docs: DataFrame, *keys: str) -> DataFrame:
    accepted = F.count_if(F.col("decision").isin("title", "text"))
    return docs.groupBy(*keys).agg(F.count("*").alias("n_docs"), accepted.alias("n_accepted"), F.round(accepted / F.count("*"), 6).alias("accept_rate"))
