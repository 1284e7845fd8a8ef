"""A training corpus from ``documents``, stage by stage.

Each stage works on all that the one before kept, is written to the shared
folder and read again, so a lost executor costs one stage's tasks at most.

All stages but the last keep every column of what they get, whatever its name. An
empty table passes through all of them and gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.common import stored
from gristmill.llm.decontamination import decontaminated
from gristmill.llm.near_duplicates import one_of_each
from gristmill.llm.packing import pack_documents
from gristmill.llm.private import redacted
from gristmill.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic.

    Each row is judged by its whole text, so repeated rows share their fate; null
    and empty texts score as no terms, and null ids matter to the fit alone.
    """
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8).

    Of repeated rows one stays, of a group the one of the smallest id (null ids
    last, ties by a hash of the text). Null, empty and blank texts have no copies
    and all stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to one half; each row by itself, null and empty texts stay."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; no row goes, and null and empty texts stay as they are."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the documents' token ids; null texts are empty, and each row is a document of its own."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: A trained model takes part, so SQL can't express it; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
