"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first(array: Column | str) -> Column:
    """First element, or NULL when there is none."""
    return F.try_element_at(F.col(array) if isinstance(array, str) else array, F.lit(1))


def last(array: Column | str) -> Column:
    return F.try_element_at(F.col(array) if isinstance(array, str) else array, F.lit(-1))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)
