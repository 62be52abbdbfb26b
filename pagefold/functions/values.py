"""Evaluating an expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often ``use`` reads it. For values read inside lambdas, where no common part is shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once per row: the optimiser would copy a plain alias into every expression that reads it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
