"""Stage trees, kept flat: an array of structs in pre-order with their depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flattened(children: Column, depth: int) -> Column:
    """Pre-order (depth, name) of nested structs ``name, children``, down to a known depth."""

    def walk(nodes: Column, level: int) -> Column:
        if level + 1 == depth:
            return F.transform(nodes, lambda x: F.struct(F.lit(level).alias("depth"), x["name"].alias("name")))
        return F.flatten(
            F.transform(
                nodes,
                lambda x: F.concat(
                    F.array(F.struct(F.lit(level).alias("depth"), x["name"].alias("name"))),
                    F.coalesce(walk(x["children"], level + 1), F.array().cast("array<struct<depth:int,name:string>>")),
                ),
            )
        )

    return walk(children, 0)


def fingerprint(stages: Column, key: Sequence[str]) -> Column:
    """SHA-256 over the key fields of stages, in order; other fields may change freely."""
    return F.sha2(F.to_json(F.transform(stages, lambda s: F.struct(*[s[k].alias(k) for k in key]))), 256)


def new_stages(old: Column, new: Column, key: Sequence[str]) -> Column:
    """Stages of ``new`` whose key isn't in ``old``, in their order."""
    keys = F.transform(F.coalesce(old, F.array()), lambda s: F.concat_ws("\u001f", *[F.coalesce(s[k].cast("string"), F.lit("\u0000")) for k in key]))
    return F.filter(new, lambda s: ~F.array_contains(keys, F.concat_ws("\u001f", *[F.coalesce(s[k].cast("string"), F.lit("\u0000")) for k in key])))


def changed_decisions(old: DataFrame, new: DataFrame, keys: Sequence[str], decision: str) -> DataFrame:
    """Stages in both states whose decision is known now and wasn't the same before."""
    before = old.select(*keys, F.col(decision).alias("before"))
    return new.join(before, list(keys)).where(F.col(decision).isNotNull() & ~F.col(decision).eqNullSafe(F.col("before")))


def frames_without_child(stages: Column) -> Column:
    """Drop a stage whose next one is deeper: the child tells what the frame would."""
    last = F.size(stages)
    return F.filter(stages, lambda s, i: ~((i + 1 < last) & (F.get(stages, i + 1)["depth"] > s["depth"])))


def last_state(stages: Column, states: Sequence[tuple[str, str]], start: str) -> Column:
    """Fold over stages in order: each stage whose name matches a pattern sets the state."""
    rule = lambda a, s: _cases(s["name"], states, a)
    return F.aggregate(stages, F.lit(start), rule)


def _cases(name: Column, states: Sequence[tuple[str, str]], other: Column) -> Column:
    out = None
    for pattern, state in states:
        out = F.when(name.rlike(pattern), F.lit(state)) if out is None else out.when(name.rlike(pattern), F.lit(state))
    return out.otherwise(other)
