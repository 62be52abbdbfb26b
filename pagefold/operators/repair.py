"""Repairing ordered items and folding them into text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repair_by_ordinal(slots: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each slot with the fresh item of the same ordinal on its page; without one the slot keeps its own."""
    nth = F.row_number().over(Window.partitionBy("page_idx").orderBy("ord"))
    new = fresh.select("page_idx", nth.alias("ordinal"), F.col("ord").alias("replacement"), F.col("x0").alias("_x0"))
    met = slots.withColumn("ordinal", nth).join(new, ["page_idx", "ordinal"], "left")
    return met.select("page_idx", "ord", "ordinal", "replacement", F.coalesce("_x0", "x0").alias("x0"), F.when(F.col("replacement").isNull(), "keep_original").otherwise("replace").alias("decision"))


def fold_markdown(items: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Items of a page in order as Markdown, blank lines between; empty and null items fall out."""
    kept = items.where(F.col(text) != "")
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("markdown"))
