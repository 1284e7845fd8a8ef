"""Parts of long documents as expressions: page furniture, covering letters, bodies, recorded cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand around a page number, and its digits.
AROUND, DIGITS = " \t-–", 4


def without_furniture(page: Column, head: Column, stamp: str | None = None) -> Column:
    """The page from its first line that isn't blank, a page number, the running head or a stamp (a pattern)."""

    def told(line: Column) -> Column:
        bare = F.btrim(line, F.lit(AROUND))
        numbers = (F.translate(bare, "0123456789", "") == "") & (F.length(bare) <= DIGITS)
        own = ~numbers & ~F.trim(line).eqNullSafe(head)
        return own & ~F.trim(line).rlike(stamp) if stamp else own

    lines = F.split(page, "\n")
    first = F.array_position(F.transform(lines, told), F.lit(True))
    return F.when(first > 0, F.array_join(F.slice(lines, first, F.size(lines)), "\n")).otherwise("")


def _found(text: Column, pattern: str) -> Column:
    """Characters before the first match; null without one."""
    return F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0)) - 1


def body(text: Column, first: str, ends: Sequence[str]) -> Column:
    """The text from the first match of ``first`` to the earliest match of any of ``ends`` after it; null without a start."""
    rest = F.substr(text, _found(text, first) + 1)
    return F.substr(rest, F.lit(1), F.least(F.length(rest), *[_found(rest, e) for e in ends]))


def without_letter(text: Column, closing: str, opening: str, within: int, page_break: str = "\f") -> Column:
    """The text after a covering letter, which ends with ``closing`` among the first ``within`` characters.

    What follows begins at ``opening`` or on the next page, whichever is first; a letter
    with neither leaves nothing, a text without a letter stays.
    """
    start = F.substring(text, 1, within)
    rest = F.substr(text, _found(start, closing) + F.length(F.regexp_extract(start, closing, 0)) + 1)
    page = F.nullif(F.locate(page_break, rest), F.lit(0)) - 1
    cut = F.least(_found(rest, opening), page)
    return F.when(~start.rlike(closing) | text.isNull(), text).otherwise(F.coalesce(F.substr(rest, cut + 1), F.lit("")))


def cleaned(text: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text after rules (name, pattern, replacement) in turn, and what each changed: (rule, found, put).

    A pattern must fit its match alone too, so it looks neither ahead nor behind.
    """

    def told(name: str, pattern: str, put: str):
        return lambda m: F.struct(F.lit(name).alias("rule"), m.alias("found"), F.regexp_replace(m, pattern, put).alias("put"))

    kept = F.array().cast("array<struct<rule:string,found:string,put:string>>")
    for rule in rules:
        _, pattern, put = rule
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), told(*rule))
        kept = F.concat(kept, F.filter(hits, lambda h: h["found"] != h["put"]))
        text = F.regexp_replace(text, pattern, put)
    return text, kept
