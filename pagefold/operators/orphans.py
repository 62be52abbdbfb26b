"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.plans.partitioning import merge_lookup


def parent_intervals(parents: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """One row per key with its validity: ``_live`` (a row without end) and ``_spans`` (its distinct intervals ``b, e``: a null begin is always, a null end still lasts).

    Copies are dropped before the shuffle; a key holds as many spans as it has different ones. Overlapping spans are
    kept side by side: a time is covered if any of them covers it. Null keys are dropped.
    """
    span = F.struct(F.col(begin).alias("b"), F.col(end).alias("e"))
    return parents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.bool_or(F.col(end).isNull()).alias("_live"), F.collect_set(span).alias("_spans"))


def resolve_references(refs: DataFrame, intervals: DataFrame, key: str, at: str, spread: str) -> DataFrame:
    """``refs`` with ``verdict``, of what their target is now and was at ``at``.

    With a target now: ``present`` (it was there), ``late`` (it began after ``at``, none was before), ``returned`` (one
    had ended by ``at``, the next began after). Without: ``lost`` (it was there, ended since), ``deleted`` (targets
    were, none at ``at``), ``missing`` (never was). A span holds from its begin to before its end.

    References and parents are partitioned and sorted by key and merged as two streams; parents come with one row per
    key, references of a frequent key are spread by ``spread``. A null key is no reference and doesn't come out; a
    null ``at`` is ``present`` if there is a target now, else ``deleted`` or ``missing``. Repeated references come out
    as often as they occur.
    """
    asked = refs.where(F.col(key).isNotNull()).withColumn("_key", F.col(key))
    met = merge_lookup(asked, intervals.select("_key", "_live", "_spans"), "_key", F.col(spread))
    begun = lambda s: s["b"].isNull() | (s["b"] <= F.col(at))
    there = F.exists("_spans", lambda s: begun(s) & (s["e"].isNull() | (s["e"] > F.col(at))))
    live = F.when(F.col(at).isNull() | there, "present").when(F.exists("_spans", begun), "returned").otherwise("late")
    gone = F.when(F.col(at).isNotNull() & there, "lost").otherwise("deleted")
    verdict = F.when(F.col("_live"), live).when(F.col("_live").isNotNull(), gone).otherwise("missing")
    return met.withColumn("verdict", verdict).drop("_key", "_live", "_spans")


def is_orphan(verdict: str = "verdict"):
    """A target that came late or again is a target; one that was there and is no more is none."""
    return F.col(verdict).isin("missing", "deleted", "lost")


def orphan_report(resolved: DataFrame, at: str) -> DataFrame:
    """Counts of each verdict per table, field and month of ``at`` (null where it is)."""
    month = F.date_format(F.date_trunc("month", at), "yyyy-MM")
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return resolved.groupBy("ref_table", "ref_field", month.alias("month")).agg(F.count(F.lit(1)).alias("refs"), *map(count, ("present", "late", "returned", "lost", "deleted", "missing")))
