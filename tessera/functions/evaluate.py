"""Control over how often an expression is evaluated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each evaluated once a row however often it is used further on.

    Projections above each other are merged by the optimizer, which repeats an expression wherever its column is used;
    a generator that makes one row of one row keeps them apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it: a function of one list element."""
    return F.transform(F.array(value), body)[0]
