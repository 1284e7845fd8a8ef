"""What a letter says of itself and of a consultation, as expressions; what it doesn't say stays null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.once import once


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def day(text: Column, months: Mapping[str, int]) -> Column:
    """A day written as '3 May 2024' or '03.05.2024'; null where that is no day."""
    names = F.create_map(*[x for name, n in months.items() for x in (F.lit(name.lower()), F.lit(n))])
    written, numeric = r"(\d{1,2})\s+(\p{L}+)\s+(\d{4})", r"(\d{1,2})\.(\d{1,2})\.(\d{4})"

    def told(t: Column) -> Column:
        part = lambda p, g: F.regexp_extract(t, p, g)
        month = F.coalesce(F.try_element_at(names, F.lower(part(written, 2))).cast("string"), F.nullif(part(numeric, 2), F.lit("")))
        number = lambda g: F.when(t.rlike(written), part(written, g)).otherwise(part(numeric, g))
        whole = F.concat(F.lpad(number(3), 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(number(1), 2, "0"))
        return F.when(t.rlike(written) | t.rlike(numeric), whole.try_cast("date"))

    return once(text, told)


def sender_number(text: Column, pattern: str, within: int) -> Column:
    """The reference that heads a letter, without blanks and with plain hyphens."""
    return F.regexp_replace(F.regexp_replace(_first(F.substring(text, 1, within), f"({pattern})"), r"[‐-―−]", "-"), r"\s", "")


def signatories(text: Column, signature: str, ends: Sequence[str], within: int) -> Column:
    """The names in signatures of a letter, which ends at the first of ``ends`` behind a few words or at ``within`` characters."""
    head = F.substring(text, 1, within)
    cut = F.least(*[F.coalesce(F.nullif(F.locate(e, head, 50), F.lit(0)), F.lit(within + 1)) for e in ends], F.lit(within + 1))
    names = F.transform(F.regexp_extract_all(F.substr(head, F.lit(1), cut - 1), F.lit(signature), F.lit(1)), flat)
    return F.filter(names, lambda n: n != "")


def consultation(text: Column, months: Mapping[str, int], dated: str, days: str, until: str, address: str) -> Column:
    """Struct (written, days, until, address): each pattern's first group, read as a day, a count, a day and a text."""
    told = lambda t: F.struct(
        day(_first(t, dated), months).alias("written"), _first(t, days).try_cast("int").alias("days"), day(_first(t, until), months).alias("until"), _first(t, address).alias("address")
    )
    return once(flat(text), told)


def deadline(told: Column, published: Column, most_days: int) -> Column:
    """The last day for comments: the day told if it lies within ``most_days`` of the letter, else so many days after it.

    A letter without a day of its own counts from ``published``. A day too far off, or
    before the letter, is taken for another one and gives way to the count of days.
    """
    start = F.coalesce(told["written"], published)
    near = (told["until"] >= start) & (told["until"] <= F.date_add(start, most_days))
    return F.when(F.coalesce(near, F.lit(False)), told["until"]).otherwise(F.date_add(start, told["days"]))
