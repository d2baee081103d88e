"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where the body has lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rounded(value: Column, digits: int = 6) -> Column:
    """Doubles as they are compared with other engines."""
    return F.round(value.cast("double"), digits)
