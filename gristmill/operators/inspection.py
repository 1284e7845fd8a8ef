"""Texts checked against a chain of anchors, each looked for behind the one before."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.names import free


@dataclass(frozen=True)
class Anchor:
    """What has to come next in a text.

    ``pattern``'s first group is the part that is told (all of the match without a
    group), read as ``kind``. ``missing`` is the limitation of a text without it,
    ``several`` of one with more than one match (null: the first counts), ``invalid``
    of a part that isn't of the kind. A ``next`` anchor has to follow at once.
    """

    name: str
    pattern: str
    missing: str
    kind: str = "string"
    invalid: str = ""
    several: str | None = None
    next: bool = False


def inspected(texts: DataFrame, text: str, anchors: Sequence[Anchor], rules: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """``texts`` with a column for each anchor's part and ``limitation``, the first that holds ('' if none does).

    Anchors behind the first limitation have no parts. ``rules`` (limitation, condition over the
    parts) are judged last, in order. A null text has the first anchor's limitation.
    """
    at, rest, hit, found = (free(f"_{x}", texts) for x in ("at", "rest", "hit", "found"))
    out = texts.withColumns({rest: F.coalesce(F.col(text), F.lit("")), found: F.lit("")})
    for a in anchors:
        fine = F.col(found) == ""
        pattern = rf"\A(?:{a.pattern})" if a.next else a.pattern
        # the part is the first group, so a whole match is one too
        out = out.withColumn(at, F.regexp_instr(rest, F.lit(pattern))).withColumn(hit, F.regexp_extract(F.substr(F.col(rest), F.col(at)), rf"\A(?:{a.pattern})", 0))
        grouped = "(" in a.pattern.replace("(?", "").replace(r"\(", "")
        part = F.regexp_extract(F.col(hit), rf"\A(?:{a.pattern})", 1 if grouped else 0)
        value = part if a.kind == "string" else part.try_cast(a.kind)
        bad = F.when(F.col(at) == 0, a.missing)
        if a.several is not None:
            bad = F.when(F.col(at) == 0, a.missing).when(F.regexp_count(F.col(rest), F.lit(pattern)) > 1, a.several)
        if a.kind != "string":
            bad = bad.when(value.isNull(), a.invalid or a.missing)
        out = out.withColumn(found, F.when(fine, F.coalesce(bad, F.lit(""))).otherwise(F.col(found)))
        fine = F.col(found) == ""
        out = out.withColumn(a.name, F.when(fine, value)).withColumn(rest, F.when(fine, F.substr(F.col(rest), F.col(at) + F.length(hit))).otherwise(F.col(rest)))
    for limitation, condition in rules:
        out = out.withColumn(found, F.when((F.col(found) == "") & F.coalesce(condition, F.lit(False)), limitation).otherwise(F.col(found)))
    names = [a.name for a in anchors]
    return out.select(*texts.columns, *names, F.col(found).alias("limitation"))
