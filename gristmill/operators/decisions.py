"""Ladders of rules: decisions of a process, stages told late, attention, what waits for the digest.

Stages are rows here. What a process has come to is its last stage of each sort,
so one aggregation by key answers it, and a process of many stages never has to
fit a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rule(rules: Sequence[tuple[Column, str]], other: str | None = None) -> Column:
    """The value of the first rule that holds; a null condition doesn't hold."""
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in rules], F.lit(other).cast("string"))


def last_known(value: Column, order: str) -> Column:
    """Aggregate: the last value in order that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def decided(stages: DataFrame, keys: Sequence[str], order: str, veto: Column, refused: Column, ended: Column, passed: str, closed: str) -> DataFrame:
    """keys, decision: what each process has come to.

    ``veto``, ``refused`` and ``ended`` name a stage's outcome or are null. A veto
    goes before a refusal, that before an end ('passed' among them), and stages go
    before the listing's own flags. Flags that contradict a passed end leave the
    decision unknown, and so does a closed process without any sign.
    ``passed`` may be null; null counts as not told, never as false.
    """
    last = stages.groupBy(*keys).agg(
        last_known(veto, order).alias("_veto"), last_known(refused, order).alias("_refused"), last_known(ended, order).alias("_ended"),
        F.max(passed).alias("_passed"), F.coalesce(F.max(closed), F.lit(False)).alias("_closed"),
    )
    denied = F.col("_closed") & F.coalesce(~F.col("_passed"), F.lit(False))
    flags = first_rule([(F.col("_passed"), "passed"), (denied, "refused"), (F.col("_closed"), "unknown")], "absent")
    end = F.when((F.col("_ended") == "passed") & denied, "unknown").otherwise(F.col("_ended"))
    return last.select(*keys, F.coalesce("_veto", "_refused", end, flags).alias("decision"))


def told_late(stages: DataFrame, keys: Sequence[str], order: str, known: Column, weighty: Column) -> DataFrame:
    """keys, late: whether every new weighty stage stands before one that was known already."""
    before = F.max(F.when(known, F.col(order)))
    newest = F.max(F.when(~known & weighty, F.col(order)))
    return stages.groupBy(*keys).agg(F.coalesce(newest < before, F.lit(False)).alias("late"))


def assessed(rows: DataFrame, rules: Sequence[tuple[Column, str, str]], deadline: Column, today: Column, urgent_days: int = 3, also: Sequence[tuple[Column, str]] = ()) -> DataFrame:
    """Rows with importance, urgency and reasons: the first rule (condition, importance, reason) decides, further reasons are added.

    Without a rule that holds, importance is 'uncertain'. A deadline from today to
    ``urgent_days`` ahead makes a row urgent.
    """
    near = F.coalesce(F.datediff(deadline, today).between(0, urgent_days), F.lit(False))
    reasons = [first_rule([(c, r) for c, _, r in rules], "unclassified"), *[F.when(c, F.lit(r)) for c, r in also], F.when(near, F.lit("near_deadline"))]
    return rows.withColumns({
        "importance": first_rule([(c, i) for c, i, _ in rules], "uncertain"),
        "urgency": F.when(near, "urgent").otherwise("normal"),
        "reasons": F.array_distinct(F.array_compact(F.array(*reasons))),
    })


def waits_because(urgency: Column, reasons: Column, sent_at_once: Sequence[str], rules: Sequence[tuple[Column, str]]) -> Column:
    """Why a notice waits for the digest; empty if it is sent at once."""
    at_once = (urgency != "normal") | F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in sent_at_once]))
    return F.when(at_once, "").otherwise(first_rule(rules, ""))


def overdue(deadline: Column, today: Column, exact: Column, grace_days: int = 7) -> Column:
    """Whether a deadline has run out, with grace unless it is exact; no deadline is never overdue."""
    return F.coalesce(F.datediff(today, deadline) > F.when(exact, 0).otherwise(grace_days), F.lit(False))


def news(changes: DataFrame, keys: Sequence[str | Column], substantive: Column, always: Column, unless_said: Column, said: Column) -> DataFrame:
    """keys, news: whether what changed deserves telling now.

    A substantive row does, and one that always counts; a row of ``unless_said`` does unless another
    one of the same key says it all. Nulls are no news.
    """
    held = lambda c: F.coalesce(F.max(c), F.lit(False))
    found = changes.groupBy(*keys).agg((held(substantive) | held(always) | (held(unless_said) & ~held(said))).alias("news"))
    return found


def verdict(triaged: Column, relevant: Column, score: Column) -> Column:
    """Why a record wasn't told: turned away at first sight, not relevant, or its score."""
    return F.when(triaged, "triage").when(relevant, F.concat(F.lit("score "), score.cast("string"))).otherwise("not relevant")
