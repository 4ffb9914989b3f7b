"""Small helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def places(first: int | Column, last: int | Column) -> Column:
    """Whole numbers from first to last, none if there are none."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda done, x: done + x)
