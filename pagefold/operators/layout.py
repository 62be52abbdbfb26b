"""Page-level layout measures of text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.operators.groups import mode_first


def fingerprints(records: DataFrame) -> DataFrame:
    """Per page: body font (most frequent, first seen among equals), widest block, one or two columns with their width and gap, median block height and paragraph gap.

    ``records`` has ``page_idx, ord``, a box, ``font`` and ``single`` (one line). Blocks of several lines count, single
    lines only where a page has no other. Gaps between blocks that overlap don't count; no gap gives 0.
    """
    any_body = F.max((~F.col("single")).cast("int")).over(Window.partitionBy("page_idx"))
    working = records.withColumn("_body", any_body).where("NOT single OR _body = 0").drop("_body")
    following = F.lead("y0").over(Window.partitionBy("page_idx").orderBy("y0", "ord"))
    spaced = working.withColumn("_gap", following - F.col("y1"))
    median = lambda c: F.percentile(c, 0.5)
    stats = spaced.groupBy("page_idx").agg(
        F.max(F.col("x1") - F.col("x0")).alias("text_region_width"),
        F.when(F.countDistinct(F.round("x0", 1)) <= 1, 1).otherwise(2).alias("text_region_columns"),
        F.round(median(F.col("y1") - F.col("y0")), 4).alias("median_text_block_height"),
        F.round(F.coalesce(median(F.when(F.col("_gap") >= 0, F.col("_gap"))), F.lit(0.0)), 4).alias("median_paragraph_gap"),
    )
    font = mode_first(working, ["page_idx"], "font", "ord").withColumnRenamed("font", "body_font_size")
    starts = working.select("page_idx", F.round("x0", 1).alias("_x")).distinct()
    nth = F.row_number().over(Window.partitionBy("page_idx").orderBy("_x"))  # the two least of each page, limited before the shuffle
    two = starts.withColumn("_n", nth).where("_n <= 2").groupBy("page_idx").agg(F.min("_x").alias("_first"), F.max("_x").alias("_second"))
    out = stats.join(font, "page_idx").join(two, "page_idx").withColumn("column_width", F.round(F.col("text_region_width") / F.col("text_region_columns"), 4))
    gap = F.when(F.col("text_region_columns") > 1, F.round(F.col("_second") - F.col("_first") - F.col("column_width"), 4)).otherwise(F.lit(0.0))
    return out.withColumn("column_gap", gap).drop("_first", "_second")


def relative_thresholds(column_width: Column, font: Column, column_gap: Column, paragraph_gap: Column) -> dict[str, Column]:
    """Thresholds that follow a page's fingerprint."""
    return {
        "panel_border_min_size": F.round(column_width * 0.3, 4),
        "color_band_min_width": F.round(column_width * 0.3, 4),
        "color_band_min_height": F.round(font * 1.2, 4),
        "image_seed_min_size": F.round(column_width * 0.6, 4),
        "cluster_max_gap": F.round(column_gap * 1.5, 4),
        "near_text_max_gap": F.round(paragraph_gap * 3, 4),
    }


#: Gap of texts attached to a side, in sizes of the body font.
ATTACHED = 4.0


def visual_thresholds(relative: dict[str, Column], font: Column) -> dict[str, Column]:
    """The fixed thresholds that a page's fingerprint replaces; all others stay as they are."""
    return {"near_body_text_max_gap": relative["near_text_max_gap"], "attachment_side_max_gap": F.round(font * ATTACHED, 4).cast("double")}


def line_spacing(lines: DataFrame, keys: list[str], font: str) -> DataFrame:
    """Mean distance of line tops over the font size per block, 1 for a single line; ``lines`` has ``y0, ord``."""
    step = F.lead("y0").over(Window.partitionBy(*keys).orderBy("y0", "ord")) - F.col("y0")
    per = lines.withColumn("_step", step).groupBy(*keys).agg(F.avg("_step").alias("_avg"), F.max(font).alias("_font"))
    return per.select(*keys, F.coalesce(F.round(F.try_divide("_avg", "_font"), 4), F.lit(1.0)).alias("line_spacing_ratio"))


def typography(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per block: font and size that most characters have (first seen among equals), variance of size around it, characters.

    ``spans`` has ``ord, text, size, font``; an empty span counts as one character.
    """
    weighed = spans.withColumn("_n", F.greatest(F.length("text"), F.lit(1)))

    def dominant(c: str, name: str) -> DataFrame:
        counted = weighed.groupBy(*keys, c).agg(F.sum("_n").alias("_w"), F.min("ord").alias("_o"))
        return counted.groupBy(*keys).agg(F.max_by(F.col(c), F.struct("_w", -F.col("_o"))).alias(name))

    size = dominant("size", "dominant_font_size")
    spread = weighed.join(size, keys).groupBy(*keys).agg((F.sum((F.col("size") - F.col("dominant_font_size")) ** 2 * F.col("_n")) / F.sum("_n")).alias("_v"), F.sum(F.length(F.trim("text"))).alias("chars"))
    return size.join(dominant("font", "dominant_font_name"), keys).join(spread.withColumn("font_size_variance", F.round("_v", 6)).drop("_v"), keys)
