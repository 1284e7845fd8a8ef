"""Stages of a process as rows: pre-order, keys, fingerprints, evidence, names, tags and phases.

A stage row carries its process and ``path``, the list of its positions from the
root down. Lists compare element by element, a prefix first, so sorting by path is
the pre-order of the tree at any depth, and no tree is ever held in one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.decisions import first_rule, last_known
from gristmill.operators.folds import ended
from gristmill.operators.names import free


def in_order(stages: DataFrame, process: Sequence[str], path: str = "path") -> DataFrame:
    """``stages`` with ``place`` in the pre-order of their process, from 0, and ``depth``."""
    w = Window.partitionBy(*process).orderBy(path)
    return stages.withColumns({"place": F.row_number().over(w) - 1, "depth": F.size(path) - 1})


def stage_prints(stages: DataFrame, process: Sequence[str], fields: Sequence[Column], path: str = "path") -> DataFrame:
    """process, stages, fingerprint: equal for processes whose stages agree in depth and fields, in order.

    Each stage is digested by itself; the digests of one process, 32 bytes each,
    are put in order and digested again.
    """
    own = F.sha2(F.concat_ws("\u001f", (F.size(path) - 1).cast("string"), *[F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("-")) for f in fields]), 256)
    listed = F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), own.alias("own"))))
    return stages.groupBy(*process).agg(F.count("*").alias("stages"), F.sha2(F.array_join(F.transform(listed, lambda x: x["own"]), ""), 256).alias("fingerprint"))


def told(stages: DataFrame, process: Sequence[str], path: str = "path") -> DataFrame:
    """Stages without the frames around others: a stage whose next one lies deeper is left out."""
    w, following = Window.partitionBy(*process).orderBy(path), free("_next", stages)
    ahead = F.col(following)
    return stages.withColumn(following, F.lead(F.size(path)).over(w)).where(ahead.isNull() | (ahead <= F.size(path))).drop(following)


def evidence(stages: DataFrame, process: Sequence[str], order: str, signs: Sequence[tuple[Column, str]], flag: Column) -> DataFrame:
    """process, evidence, source: the last stage that shows an outcome by a sign; without any, the listing's flag.

    ``signs`` are (condition, outcome), the first that holds counts for a stage.
    ``flag`` is true, false or null for passed, rejected or not told.
    """
    sign, told = free("_shown", stages), free("_flag", stages)
    shown = stages.groupBy(*process).agg(last_known(first_rule(signs), order).alias(sign), F.max(flag).alias(told))
    by_flag = F.when(F.col(told), "passed").when(~F.col(told), "rejected")
    source = F.when(F.col(sign).isNotNull(), "stage").when(F.col(told).isNotNull(), "flag").otherwise("none")
    return shown.select(*process, F.coalesce(sign, by_flag, F.lit("unknown")).alias("evidence"), source.alias("source"))


def named(rows: DataFrame, names: Sequence[tuple[Column, str]], tags: Sequence[tuple[Column, str]], other: str) -> DataFrame:
    """``rows`` with ``event``, the first name whose condition holds, and ``tags``, all that hold, each once and in order."""
    held = F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in tags])))
    return rows.withColumns({"event": first_rule(names, other), "tags": held})


#: Moves of a machine: (phase, stage) -> next phase.
Moves = Mapping[tuple[str, str], str]


def phases(stages: DataFrame, process: Sequence[str], order: str, stage: str, moves: Moves, start: str) -> DataFrame:
    """process, phase, moved: where the moves lead from ``start`` over a process's stages in order, ties by name.

    A stage without a move from the phase at hand is passed over. Stages stream by
    the fold, so a process may have any number of them.
    """
    at, name = free("_order", stages), free("_stage", stages)
    told = stages.select(*process, F.col(order).alias(at), F.col(stage).alias(name))
    dealt = told.repartition(*process).sortWithinPartitions(*process, at, name).select(*process, name)
    table = dict(moves)

    def step(state: tuple[str, int], x: str | None) -> tuple[str, int]:
        to = table.get((state[0], x), state[0])
        return to, state[1] + (to != state[0])

    end = free("_end", stages)
    out = ended(dealt, len(process), lambda: (start, 0), step, lambda s: {"phase": s[0], "moved": s[1]}, end, "struct<phase:string,moved:int>")
    return out.select(*process, f"{end}.phase", f"{end}.moved")


def continued(lines: DataFrame, doc: Sequence[str], order: str, opens: Column) -> DataFrame:
    """``lines`` with ``item``: lines that don't open an item go on with the one before; those before the first are item 0."""
    w = Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("item", F.count_if(opens).over(w))
