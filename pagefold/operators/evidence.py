"""Negative evidence: reasons against a candidate, kept in the order they were found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_reasons(reasons: Column) -> Column:
    """Reasons without nulls, blanks and repeats, in order; a null list is empty."""
    return F.array_distinct(F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: r != ""))


def marked(reasons: Column, more: Column) -> Column:
    """Reasons with further ones behind."""
    return normal_reasons(F.concat(F.coalesce(reasons, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>"))))


def has_reasons(reasons: str) -> Column:
    return F.size(normal_reasons(F.col(reasons))) > 0


def active(candidates: DataFrame, reasons: str) -> DataFrame:
    """Candidates that nothing speaks against."""
    return candidates.where(~has_reasons(reasons))


def merged_reasons(candidates: DataFrame, group: str, order: str, reasons: str) -> DataFrame:
    """``group, reasons``: the reasons of all candidates of a group, in the order they first occur; groups without any don't come out.

    First occurrences are combined before the shuffle, so a group holds as many rows as it has different reasons.
    """
    each = candidates.select(group, F.col(order).alias("_o"), F.posexplode(normal_reasons(F.col(reasons))).alias("_i", "_r"))
    first = each.groupBy(group, "_r").agg(F.min(F.struct("_o", "_i")).alias("_at"))
    return first.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_r"))), lambda x: x["_r"]).alias("reasons"))
