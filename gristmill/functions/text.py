"""Text expressions. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java needs both flags for letters beyond ASCII: classes (U) and case (u).
UNICODE = "(?iuU)"


def normalised(text: Column) -> Column:
    """No-break spaces count as spaces, runs of white space as one, ends are trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "\u00a0", " "), "[ \\t\\n\\r\\f\\x0B]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text; equal for texts that differ in spacing alone."""
    return F.sha2(normalised(text), 256)


def keyword_counts(text: Column, patterns: Mapping[str, str]) -> Column:
    """map(name -> matches), without names that don't match. Null texts give an empty map."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\u00a0", " ")
    pairs = [F.struct(F.lit(n).alias("key"), F.regexp_count(clean, F.lit(UNICODE + p)).cast("long").alias("value")) for n, p in sorted(patterns.items())]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"] > 0))


def keyword_hits(text: Column, patterns: Mapping[str, str]) -> Column:
    """The names that match, in alphabetical order."""
    clean = F.translate(F.coalesce(text, F.lit("")), "\u00a0", " ")
    return F.array_compact(F.array(*[F.when(clean.rlike(UNICODE + p), F.lit(n)) for n, p in sorted(patterns.items())]))


def strong_hit(hits: Column, weak: Sequence[str]) -> Column:
    """A short text passes with one hit that isn't weak."""
    return F.size(F.array_except(hits, F.array(*[F.lit(w) for w in weak]))) > 0


def enough_hits(counts: Column, weak: Sequence[str], least_distinct: int = 2, least_total: int = 3) -> Column:
    """A long text passes with enough different or enough total hits, but never on weak ones alone.

    One fold over the counts, so that the patterns run once a text.
    """
    zero = F.struct(F.lit(0).alias("names"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("strong"))
    return F.aggregate(
        F.map_entries(counts),
        zero,
        lambda a, x: F.struct((a["names"] + 1).alias("names"), (a["total"] + x["value"]).alias("total"), (a["strong"] | ~x["key"].isin(*weak)).alias("strong")),
        lambda a: a["strong"] & ((a["names"] >= least_distinct) | (a["total"] >= least_total)),
    )


def contains_folded(text: Column, needle: str) -> Column:
    return F.instr(F.lower(text), needle.lower()) > 0


#: Named entities, fixed values; numeric ones follow a rule.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»",
    "bdquo": "„", "rdquo": "”", "ldquo": "“", "sect": "§", "amp": "&",
}
NUMERIC = r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"


def decoded(text: Column) -> Column:
    """``text`` with its entities as characters; an unknown name stays, a number that is no character becomes a mark."""
    told = F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0))
    hexed = lambda e: F.lower(F.substring(e, 3, 1)) == "x"
    point = lambda e: F.when(hexed(e), F.conv(F.substr(e, F.lit(4), F.length(e) - 4), 16, 10)).otherwise(F.substr(e, F.lit(3), F.length(e) - 3)).cast("int")
    valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    put = F.transform(told, lambda e: F.when(valid(point(e)), char(point(e))).otherwise("\ufffd"))
    parts = F.split(text, NUMERIC, -1)
    whole = F.array_join(F.flatten(F.transform(parts, lambda p, i: F.array(p, F.coalesce(F.get(put, i), F.lit(""))))), "")
    out = F.when(F.size(told) > 0, whole).otherwise(text)
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return out


def html_text(html: Column) -> Column:
    """Text of markup: scripts, styles and comments go, block ends become new lines, entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    out = decoded(out)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


def reference_numbers(text: Column, pattern: str = r"(\d{2,})(?:-[A-Z])?") -> Column:
    """Distinct numbers in order of appearance, without letter suffixes."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


#: Numerals of 0 to 9 for units, tens and hundreds; thousands go up to three.
_DIGITS = [["", *d.split()] for d in ("I II III IV V VI VII VIII IX", "X XX XXX XL L LX LXX LXXX XC", "C CC CCC CD D DC DCC DCCC CM", "M MM MMM")]
_NUMERAL = r"^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def roman_value(numeral: Column) -> Column:
    """Value of a well-formed numeral up to 3999 in either case; null for anything else, the empty text too."""
    upper = F.upper(numeral)
    place = lambda k: (F.array_position(F.array(*[F.lit(d) for d in _DIGITS[k]]), F.regexp_extract(upper, _NUMERAL, 4 - k)) - 1) * 10**k
    return F.when(upper.rlike(_NUMERAL) & (upper != ""), (place(3) + place(2) + place(1) + place(0)).cast("int"))


def roman_numeral(value: Column) -> Column:
    """The numeral of 1 to 3999; null outside."""
    digit = lambda k: F.get(F.array(*[F.lit(d) for d in _DIGITS[k]]), (F.floor(value / 10**k) % 10).cast("int"))
    return F.when(value.between(1, 3999), F.concat(*[digit(k) for k in (3, 2, 1, 0)]))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as messengers count it."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def name_key(name: Column) -> Column:
    """Key of a name: lower case, hyphens and spaces alike."""
    return F.lower(F.trim(F.regexp_replace(name, r"[\s-]+", " ")))


def squashed_key(name: Column) -> Column:
    """Weaker key of a name: its letters and digits alone."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", ""))


def clipped(text: Column, limit: int) -> Column:
    """The text up to ``limit`` characters, cut at a space where there is one and marked with dots."""
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*\z", ""), F.lit("...")))


def clipped_keeping(text: Column, limit: int, naming: str, keeping: Column) -> Column:
    """As :func:`clipped`, but a reference that the text was shown for stays: where the head has lost all of them, the first goes behind it.

    ``naming`` is what stands before a reference and ``keeping`` the references; what is kept begins there
    and has at most half of ``limit``.
    """
    named = F.concat(F.lit(f"(?s){naming}(?:"), F.array_join(keeping, "|"), F.lit(r")\b"))
    tail = F.left(F.regexp_substr(text, F.concat(named, F.lit(".*"))), F.lit(limit // 2))
    head = clipped(text, limit)
    short = F.regexp_replace(F.substr(text, F.lit(1), F.lit(limit - 4) - F.length(tail)), r"\s+\S*\z", "")
    lost = (F.length(text) > limit) & (F.size(keeping) > 0) & tail.isNotNull() & F.regexp_substr(head, named).isNull()
    return F.when(lost, F.concat(short, F.lit("... "), tail)).otherwise(head)


def any_contains_folded(texts: Column, lists: Column, needle: str) -> Column:
    """Whether a text or any item of a list holds the needle, whatever its case; nulls hold nothing."""
    return F.coalesce(contains_folded(texts, needle), F.lit(False)) | F.coalesce(F.exists(lists, lambda x: F.coalesce(contains_folded(x, needle), F.lit(False))), F.lit(False))


def typographic(text: Column) -> Column:
    """The text with plain quotes, dashes and spaces: equal for versions that were typeset differently."""
    plain = F.translate(text, "„“”‘’‐‑‒–—­", "\"\"\"''-----")
    return normalised(plain)


def planned_quarter(text: Column, word: str = "quarter") -> Column:
    """``2031-Q2`` of a plan like "I / II quarter 2031": of several numerals the last; null unless it is one to four."""
    pattern = rf"(?i)\b([IVX]+(?:\s*/\s*[IVX]+)*)\s+{word}\s+([0-9]{{4}})"
    number = roman_value(F.trim(F.element_at(F.split(F.regexp_extract(text, pattern, 1), "/"), -1)))
    return F.when(number.between(1, 4), F.concat_ws("-Q", F.regexp_extract(text, pattern, 2), number.cast("string")))


def worded_date(text: Column, months: Sequence[str]) -> Column:
    """The first date like "3 May 2026" whose month is one of twelve names; null if there is none or no such day."""
    pattern = rf"(?iu)\b(\d{{1,2}})\s+({'|'.join(months)})\s+(\d{{4}})\b"
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in months]), F.lower(F.regexp_extract(text, pattern, 2))).cast("string")
    parts = [F.regexp_extract(text, pattern, 3), F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(text, pattern, 1), 2, "0")]
    return F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def page_body(page: Column) -> Column:
    """The page without leading blank lines and page numbers, decorated or not."""
    return F.regexp_replace(page, r"\A(?:[ \t]*(?:[-–]?[ \t]*\d{1,4}[ \t]*[-–]?)?[ \t]*\r?\n)+", "")


def within_budget(text: Column, limit: int, head_share: float = 0.75, gap: str = " [...] ") -> Column:
    """The text, or its head and its end around a mark, at most ``limit`` characters in all."""
    head = int((limit - len(gap)) * head_share)
    tail = limit - len(gap) - head
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(gap), F.right(text, F.lit(tail))))


def first_kind(text: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """The first rule (kind, pattern) that the text matches."""
    out = None
    for kind, pattern in rules:
        out = F.when(text.rlike(pattern), kind) if out is None else out.when(text.rlike(pattern), kind)
    return out.otherwise(other)
