"""Column names that an operator adds for itself: never one that its input has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(name: str, *frames: DataFrame) -> str:
    """``name``, with a number behind it if a frame has it already (Spark's names know no case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    n, found = 0, name
    while found.lower() in taken:
        n, found = n + 1, f"{name}{n}"
    return found
