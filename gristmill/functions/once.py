"""A value that an expression names several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, tell: Callable[[Column], Column]) -> Column:
    """What ``tell`` makes of ``value``, worked out once: a lambda that names a column's expression would work it out for each element."""
    return F.element_at(F.transform(F.array(value), tell), 1)
