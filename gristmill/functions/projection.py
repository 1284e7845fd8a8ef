"""Where copied text comes from: segments (at, length, source) of an emitted text, in order.

A segment without a source was made up, such as a mark between two excerpts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "struct<at:int,length:int,source:int>"


def _segment(at: Column, length: Column, source: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), length.cast("int").alias("length"), source.cast("int").alias("source"))


def source_of(segments: Column, at: Column) -> Column:
    """The source position of one position of the emitted text; null where it was made up or lies outside."""
    held = F.get(F.filter(segments, lambda s: (s["at"] <= at) & (at < s["at"] + s["length"])), F.lit(0))
    return held["source"] + at - held["at"]


def sliced(segments: Column, start: Column, end: Column) -> Column:
    """Segments of the part from ``start`` to ``end`` (exclusive), which begins at 0 again."""
    parts = F.transform(
        segments,
        lambda s: _segment(
            F.greatest(s["at"], start) - start,
            F.least(s["at"] + s["length"], end) - F.greatest(s["at"], start),
            s["source"] + F.greatest(s["at"], start) - s["at"],
        ),
    )
    return F.filter(parts, lambda s: s["length"] > 0)


def composed(later: Column, earlier: Column) -> Column:
    """Segments of a text cut from a text that was itself cut: traced to the first source."""

    def through(s: Column) -> Column:
        inner = sliced(earlier, s["source"], s["source"] + s["length"])
        traced = F.transform(inner, lambda x: _segment(s["at"] + x["at"], x["length"], x["source"]))
        return F.when(s["source"].isNull(), F.array(s)).otherwise(traced)

    return F.flatten(F.transform(later, through))


def joined(pieces: Column, gap: str) -> tuple[Column, Column]:
    """(text, segments) of ``pieces`` (text, source) with ``gap`` between them; empty pieces have no segment."""
    step = len(gap)
    ends = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p["text"]) + step)
    own = F.transform(pieces, lambda p, i: _segment(ends(i), F.length(p["text"]), p["source"]))
    marks = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, i: _segment(ends(i + 1) - step, F.lit(step), F.lit(None)))
    every = F.array_sort(F.filter(F.concat(own, marks), lambda s: s["length"] > 0))
    return F.array_join(F.transform(pieces, lambda p: p["text"]), gap), every
