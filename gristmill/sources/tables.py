"""Readers. Schemas are fixed; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.once import once
from gristmill.operators.keyed import first_per_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped_headers(columns: Sequence[str], prefixes: Mapping[str, str], required: Sequence[str]) -> dict[str, str]:
    """Header -> field, each by its longest known prefix; missing required fields are an error."""
    found = {}
    for header in columns:
        plain = " ".join(header.split()).lower()
        fits = [p for p in prefixes if plain.startswith(p.lower())]
        if fits:
            found[header] = prefixes[max(fits, key=len)]
    missing = sorted(set(required) - set(found.values()))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return found


def read_register(spark: SparkSession, path: str, prefixes: Mapping[str, str], key: str, published: str, date_format: str = "yyyy-MM-dd HH:mm") -> DataFrame:
    """A register in CSV with quoted multi-line fields: rows without a key or a date go, the newest of a key stays.

    Of rows published at the same time the first in the file stays.
    """
    rows = _register(spark, path, prefixes, key, published, date_format).where("reason is null")
    return first_per_key(rows, [key], [F.desc(published), F.asc("position")]).drop("position", "reason")


def register_rejects(spark: SparkSession, path: str, prefixes: Mapping[str, str], key: str, published: str, date_format: str = "yyyy-MM-dd HH:mm") -> DataFrame:
    """The rows that :func:`read_register` passes over, and why: 'no key' or 'no date'; their dates read as null."""
    return _register(spark, path, prefixes, key, published, date_format).where("reason is not null").drop("position")


def _register(spark: SparkSession, path: str, prefixes: Mapping[str, str], key: str, published: str, date_format: str) -> DataFrame:
    """The register's fields, ``position`` in the file, and ``reason``, why a row doesn't count (null if it does)."""
    raw = spark.read.csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"')
    names = mapped_headers(raw.columns, prefixes, [key, published])
    if {"position", "reason"} & set(names.values()):
        raise ValueError("position and reason are no fields of a register")
    rows = raw.select(*[F.trim(F.col(f"`{h}`")).alias(f) for h, f in names.items()], F.monotonically_increasing_id().alias("position"))
    rows = rows.withColumn(published, F.try_to_timestamp(published, F.lit(date_format)))
    reason = F.when(F.coalesce(F.col(key), F.lit("")) == "", "no key").when(F.col(published).isNull(), "no date")
    return rows.withColumn("reason", reason)


def read_json_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Captured pages of a listing: one JSON array or object a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def decoded_address(encoded):
    """An address hidden as hexadecimal bytes, the first of which masks the others; null where that is too short or not hexadecimal."""

    def shown(x):
        size = F.floor(F.length(x) / 2).cast("int") - 1
        plain = F.decode(F.unhex(masked(F.substr(x, F.lit(3), size * 2), F.substring(x, 1, 2))), "ISO-8859-1")
        return F.when((F.length(x) >= 4) & x.rlike("^[0-9A-Fa-f]+$"), plain)

    return once(encoded, shown)


def masked(digits, mask):
    """Hexadecimal ``digits`` of whole bytes, each byte masked with ``mask`` (two digits); seven bytes are a number at once."""
    number = lambda x: F.conv(x, 16, 10).cast("long")

    def told(x):
        n = F.ceil(F.length(x["digits"]) / 14).cast("int")
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.hex(number(F.rpad(F.substr(x["digits"], i * 14 - 13, F.lit(14)), 14, "0")).bitwiseXOR(x["mask"])), 14, "0"))
        return F.when(n > 0, F.substr(F.array_join(parts, ""), F.lit(1), F.length(x["digits"]))).when(n == 0, "")

    return once(F.struct(digits.alias("digits"), number(F.repeat(mask, 7)).alias("mask")), told)
