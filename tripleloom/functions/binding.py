"""Values bound once for use inside list functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that a list function's lambda refers to is otherwise put into the lambda as its
    whole expression and computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
