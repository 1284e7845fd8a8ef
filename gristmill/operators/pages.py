"""Texts in pages: splitting, density, running heads, kinds, trimming, excerpts, splitting for messages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import first_kind
from gristmill.operators.excerpting import places
from gristmill.operators.figures import majority_value


def pages_of(docs: DataFrame, key: str, text: str, separator: str = "\f") -> DataFrame:
    """One row a page: key, page (from 0), body."""
    return docs.select(key, F.posexplode(F.split(text, separator)).alias("page", "body"))


def density(pages: DataFrame, key: str, least_chars: int = 300) -> DataFrame:
    """Characters a page, and whether that is too thin for a text (a scan)."""
    by = pages.groupBy(key).agg(F.count("*").alias("pages"), F.sum(F.length(F.trim("body"))).alias("chars"))
    return by.withColumn("thin", F.col("chars") / F.col("pages") < least_chars)


def running_heads(pages: DataFrame, key: str, least_pages: int = 4) -> DataFrame:
    """The opening line that most of a document's pages share."""
    lines = pages.select(key, F.trim(F.element_at(F.split("body", "\n"), 1)).alias("line"))
    return majority_value(lines, [key], "line", least_pages)


def page_kinds(pages: DataFrame, rules: Sequence[tuple[str, str]], head_chars: int = 1200, other: str = "text") -> DataFrame:
    """Pages with the first rule that their head matches."""
    return pages.withColumn("kind", first_kind(F.substring("body", 1, head_chars), rules, other))


def trimmed(pages: DataFrame, key: str, keep: Column, opens: Column) -> DataFrame:
    """Pages of kept sections: ``opens`` pages decide (``keep`` or not), the pages after them follow."""
    w = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(opens, keep), ignorenulls=True).over(w)
    return pages.withColumn("kept", F.coalesce(state, F.lit(True)))


def excerpts(docs: DataFrame, key: str, text: str, pattern: str, width: int = 80) -> DataFrame:
    """key, n, start, end, excerpt: windows of ``width`` characters around matches, whatever their case, merged where they touch.

    Matches must not be empty; null texts have none.
    """
    at = places(docs, key, text, f"(?iu){pattern}").where("start is not null")
    met = at.join(docs.select(key, F.length(text).alias("size")), key)
    wide = met.select(key, F.greatest(F.col("start") - width, F.lit(0)).alias("a"), F.least(F.col("end") + width, F.col("size")).alias("b"))
    before = Window.partitionBy(key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy(key).orderBy("a", "b")
    apart = wide.withColumn("new", F.when(F.col("a") <= F.max("b").over(before), 0).otherwise(1))
    merged = apart.withColumn("n", F.sum("new").over(line) - 1).groupBy(key, "n").agg(F.min("a").alias("start"), F.max("b").alias("end"))
    cut = F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))
    return merged.join(docs.select(key, text), key).select(key, F.col("n").cast("int").alias("n"), "start", "end", cut.alias("excerpt"))


def _part_ends(text: str, limit: int) -> Iterator[int]:
    """Where each part of ``text`` ends: after the last space that fits, else where the limit is."""
    n = len(text)
    # only characters beyond the first plane take two units
    wide = max(text, default="") > "\uffff"
    units = np.cumsum(1 + (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 0xFFFF)) if wide else None
    at = 0
    while True:
        fits = at + limit if units is None else int(np.searchsorted(units, (units[at - 1] if at else 0) + limit, "right"))
        if fits >= n:
            yield n
            return
        at = text.rfind(" ", at, fits) + 1 or fits
        yield at


def message_parts(docs: DataFrame, key: str, text: str, limit: int = 4096) -> DataFrame:
    """Texts cut at spaces into parts of at most ``limit`` (2 or more) UTF-16 units; joined, the parts give the text."""

    def parts(t: str) -> Iterator[str]:
        at = 0
        for end in _part_ends(t, limit):
            yield t[at:end]
            at = end

    return _in_parts(docs, key, text, parts)


def facts(docs: DataFrame, keys: Sequence[str], text: str, patterns: Mapping[str, str]) -> DataFrame:
    """keys, kind, value: what each pattern finds; a kind with several values in one bundle may contradict itself."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("values")) for k, p in patterns.items()])
    return docs.select(*keys, F.explode(found).alias("f")).select(*keys, "f.kind", F.explode("f.values").alias("value"))


def _units(s: str) -> int:
    """UTF-16 units."""
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


_RUN, _PIECE, _TAG = re.compile(r"<[^>]*>|&#?\w+;|[^<&]+|[<&]"), re.compile(r"\s+|\S+"), re.compile(r"<(/?)([A-Za-z][\w-]*)")


def _markup_parts(html: str, limit: int) -> Iterator[str]:
    """Parts of at most ``limit`` UTF-16 units; tags open at a cut are closed there and opened again."""
    opened: list[tuple[str, str]] = []
    # the part in pieces, its units, and those of the tags that would close it
    part, size, closing, fresh = [], 0, 0, True
    close = lambda: "".join(f"</{n}>" for n, _ in reversed(opened))


    def pieces() -> Iterator[str]:
        """Tags, entities, words and blanks; what fits of a run of words is one piece."""
        for match in _RUN.finditer(html):
            run, at = match[0], 0
            if run[0] in "<&":
                yield run
                continue
            while at < len(run):
                fits = limit - size - closing
                if len(run) - at <= fits and _units(run[at:]) <= fits:
                    yield run[at:]
                    break
                k = at + fits if fits > 0 and run[at : at + fits].isascii() else at
                while k > at and run[k - 1].isspace() == run[k].isspace():
                    k -= 1
                k = k if k > at else _PIECE.match(run, at).end()
                yield run[at:k]
                at = k

    for piece in pieces():
        tag = _TAG.match(piece) if piece[0] == "<" else None
        # one long word may have to be cut; tags and entities never are
        for bit in [piece] if tag or piece[0] == "&" or size + len(piece) + closing <= limit and size + _units(piece) + closing <= limit else [piece[i : i + limit // 4] for i in range(0, len(piece), limit // 4)]:
            room = _units(f"</{tag[2]}>") if tag and not tag[1] else 0
            own = _units(bit)
            if not fresh and not (tag and tag[1]) and size + own + closing + room > limit:
                yield "".join(part) + close()
                part, fresh = [t for _, t in opened], True
                size = sum(map(_units, part))
            part.append(bit)
            size += own
            fresh = fresh and bool(tag)
        if tag and tag[1]:
            if opened and opened[-1][0] == tag[2].lower():
                closing -= _units(f"</{opened.pop()[0]}>")
        elif tag and not piece.endswith("/>"):
            opened.append((tag[2].lower(), piece))
            closing += _units(f"</{opened[-1][0]}>")
    if not fresh or "".join(part) != "".join(t for _, t in opened):
        yield "".join(part) + close()


#: Characters of text that a task turns into parts at once.
MOST_HELD = 4_000_000


def _in_parts(docs: DataFrame, key: str, text: str, parts: Callable[[str], Iterable[str]]) -> DataFrame:
    """key, part, body: what ``parts`` makes of each text, in batches of about ``MOST_HELD`` characters."""
    names = [key, "part", "body"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for k, t in zip(*batch.columns, strict=True):
                k = k.as_py()
                for n, body in enumerate(parts(t.as_py() or "")):
                    rows.append((k, n, body))
                    held += len(body)
                    if held >= MOST_HELD:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, part int, body string")


def markup_parts(docs: DataFrame, key: str, html: str, limit: int = 4096) -> DataFrame:
    """Simple message markup (paired tags) cut into parts that each stand alone; empty texts have no part."""
    return _in_parts(docs, key, html, lambda t: _markup_parts(t, limit))
