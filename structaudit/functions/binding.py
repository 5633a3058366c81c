"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it.

    Spark does not share subexpressions inside lambda functions; a lambda variable is a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
