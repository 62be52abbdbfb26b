"""Capping the records of dominant contributors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.plans.partitioning import ordered_positions


def cap_contributors(df: DataFrame, contributor: str, order: list[Column], *, cap: int | None = None, share: float | None = None) -> DataFrame:
    """All rows that name a contributor, with ``position`` (1 = best) and ``kept``.

    At most ``cap`` rows, or ``share`` of all rows (rounded down, one at least), stay per contributor: the first in
    ``order``, which must end in a unique key. A global range sort by contributor and order spreads a dominant
    contributor over many partitions; counts per partition give exact positions without gathering a contributor.
    Rows with a null contributor are no one's and don't come out. Repeated rows count as rows. An empty table gives
    an empty one. Columns called ``position``, ``kept``, ``group_pos``, ``_pid`` or ``_at`` may not be in ``df``.
    """
    if (cap is None) == (share is None):
        raise ValueError("give either cap or share")
    owned = df.where(F.col(contributor).isNotNull())
    if cap is None:
        if not 0 < share <= 1:
            raise ValueError("share lies in (0, 1]")
        cap = max(1, int(share * owned.count()))
    placed = ordered_positions(owned, contributor, order)
    return placed.withColumn("position", F.col("group_pos") + 1).withColumn("kept", F.col("group_pos") < F.lit(int(cap))).drop("group_pos")
