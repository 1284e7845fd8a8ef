"""Expressions over the wording of titles, letters and quotes, inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import first_kind, roman_value


def by_opening(title: Column, openings: Sequence[tuple[str, str]], other: str) -> Column:
    """The kind whose opening the title starts with, white space and case aside; the first one listed counts."""
    plain = F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))
    return F.coalesce(*[F.when(plain.startswith(start.lower()), F.lit(kind)) for start, kind in openings], F.lit(other))


def short_title(title: Column, openings: Sequence[str]) -> Column:
    """The title without the formal openings it starts with, its first letter raised."""
    rest = F.trim(F.regexp_replace(title, rf"(?i)^\s*(?:(?:{'|'.join(openings)})\s+)+", ""))
    return F.concat(F.upper(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2)))


def quoted_at(source: Column, quote: Column) -> Column:
    """Where a quote stands in its source (from 1), with white space of any length where the quote has some; 0 if nowhere, null for an empty quote."""
    words = F.filter(F.split(quote, r"\s+"), lambda w: w != "")
    literal = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}\s])", r"\\$1")), r"\s+")
    return F.when(F.size(words) > 0, F.regexp_instr(source, literal))


def deadline(told: Column, published: Column, days: Column) -> Column:
    """The day that is told, else so many days after publication, else null."""
    return F.coalesce(told, F.date_add(published, days))


def estimated_tokens(chars: Column, chars_per_token: float = 4.0) -> Column:
    return F.ceil(chars / chars_per_token).cast("long")


def money(amount: Column, sign: str = "$") -> Column:
    """Cents and thousands marked; small amounts that aren't nothing read as less than a cent."""
    return F.when((amount > 0) & (amount < 0.01), f"<{sign}0.01").otherwise(F.concat(F.lit(sign), F.format_number(amount, 2)))


def content_key(*parts: Column) -> Column:
    """SHA-256 over parts in order; nulls differ from empty texts, and parts can't run into each other."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]), 256)


def derived_numbers(text: Column, pattern: str) -> Column:
    """The distinct numbers that a pattern's group finds, in ascending order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("long"))))


def condition_kind(note: Column, conditional: str, kinds: Sequence[tuple[str, str]], other: str) -> Column:
    """What a note waits for: the first (kind, pattern) that fits the first group of ``conditional``; null for a plain note."""
    return F.when(note.rlike(conditional), first_kind(F.regexp_extract(note, conditional, 1), kinds, other))


def conditional_items(note: Column, until: str, naming: str) -> Column:
    """The items that a condition is about, ascending; none if it names none, null for a plain note.

    Behind ``naming`` and up to the condition a note lists numerals and ranges
    ("II, IV to VI and X"); a piece that isn't one is passed over.
    """
    clause = F.regexp_extract(note, rf"{naming}(.*?){until.replace('(?i)', '')}", 1)
    pieces = F.split(F.trim(clause), r"\s*(?:,|\band\b)\s*")
    bounds = F.transform(pieces, lambda p: F.transform(F.split(F.trim(p), r"\s+to\s+"), lambda n: roman_value(n)))
    fit = F.filter(bounds, lambda b: ~F.exists(b, lambda n: n.isNull()))
    ranges = F.transform(fit, lambda b: F.sequence(F.array_min(b), F.array_max(b)))
    return F.when(note.rlike(until), F.array_sort(F.array_distinct(F.flatten(ranges))))


def change_key(parts: Sequence[Column], closed: Column, filed: Column) -> Column:
    """A key for a state: its parts, whether it has ended, and what was filed, whatever the order and however often."""
    listed = F.when(F.size(filed) > 0, F.array_join(F.array_sort(F.array_distinct(filed)), ","))
    return content_key(*parts, F.when(closed, "closed"), listed)
