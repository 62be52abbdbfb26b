"""Grouping, suppression and ranking of boxes on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions.geometry import cover_of_first, cover_of_smaller, gap, iou
from pagefold.operators.boxjoin import box_join, self_pairs
from pagefold.operators.components import connected_components
from pagefold.operators.pagegraph import text_barriers
from pagefold.plans.partitioning import ordered_positions
from pagefold.plans.shared import checkpointed


def page_clusters(boxes: DataFrame, max_gap: float, texts: DataFrame | None = None, barrier: float = 0.8) -> DataFrame:
    """``page_idx, ord, cluster``: boxes of a page linked by gaps of at most ``max_gap`` (and no text between), ``cluster`` the smallest ord.

    Links come from a range join; components are found over all pages at once, so a dense page is no single task.
    """
    links = self_pairs(boxes.select("page_idx", "ord", "x0", "y0", "x1", "y1"), reach=max_gap, where=gap("a_", "b_") <= max_gap)
    if texts is not None:
        links = checkpointed(links)  # read by the barriers and the join
        links = links.join(text_barriers(links, texts, barrier), ["page_idx", "a_ord", "b_ord"], "left_anti")
    return linked_groups(boxes, links)


def linked_groups(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """``page_idx, ord, cluster`` of boxes that ``links(page_idx, a_ord, b_ord)`` join, ``cluster`` the smallest ord; a box without link is its own."""
    key = lambda c: F.concat_ws("/", F.lpad(F.col("page_idx").cast("string"), 20, "0"), F.lpad(F.col(c).cast("string"), 10, "0"))
    found = connected_components(links.select(key("a_ord").alias("a"), key("b_ord").alias("b")))
    part = lambda c, i: F.split(c, "/")[i].cast("bigint")
    known = found.select(part("node", 0).alias("page_idx"), part("node", 1).cast("int").alias("ord"), part("component", 1).cast("int").alias("_c"))
    return boxes.select("page_idx", "ord").join(known, ["page_idx", "ord"], "left").select("page_idx", "ord", F.coalesce("_c", "ord").alias("cluster"))


def union_boxes(boxes: DataFrame, *keys: str) -> DataFrame:
    """The box around each group, with its members in order and their number by kind."""
    return boxes.groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("kind") == "raster_image").alias("rasters"), F.count_if(F.col("kind") == "vector_cluster").alias("vectors")
    )


def isolated(boxes: DataFrame, others: DataFrame, max_gap: float) -> DataFrame:
    """Boxes without another box within ``max_gap``."""
    box = ("page_idx", "ord", "x0", "y0", "x1", "y1")
    return box_join(boxes.select(*box), others.select(*box), reach=max_gap, where=(F.col("a_ord") != F.col("b_ord")) & (gap("a_", "b_") <= max_gap), how="left_anti")


def suppress(boxes: DataFrame, order: list[Column], max_iou: float = 0.8, max_cover: float = 0.9) -> DataFrame:
    """``boxes`` with ``kept``: going through each page in ``order``, a box stays unless one that stayed makes it redundant.

    Redundant: IoU above ``max_iou`` or coverage of the smaller above ``max_cover``. Only redundant pairs are joined;
    rounds then settle boxes whose better rivals are all settled: without a kept rival a box stays, with one it goes.
    This is the sequential result, found without gathering a page. ``order`` must end in a unique key.
    """
    ranked = ordered_positions(boxes, "page_idx", order).withColumnRenamed("group_pos", "_rank")
    slim = ranked.select("page_idx", "ord", "_rank", "x0", "y0", "x1", "y1")
    rivals = box_join(slim, slim, where=(F.col("a__rank") < F.col("b__rank")) & ((iou("a_", "b_") > max_iou) | (cover_of_smaller("a_", "b_") > max_cover)))
    gone = losers(rivals.select("page_idx", F.col("a_ord").alias("better"), F.col("b_ord").alias("worse")))
    return ranked.join(gone.withColumn("_gone", F.lit(True)), ["page_idx", "ord"], "left").withColumn("kept", F.col("_gone").isNull()).drop("_rank", "_gone")


def losers(rivals: DataFrame) -> DataFrame:
    """``page_idx, ord`` of what falls out when ``better`` removes ``worse``, one after the other in an order that ``better`` comes first in.

    Per round, those that nothing open removes stay and remove theirs; a row of ``rivals(page_idx, better, worse)`` with a
    settled end is done. No page is gathered.
    """
    rivals = checkpointed(rivals)
    gone = rivals.select("page_idx", F.col("worse").alias("ord")).limit(0)
    while not rivals.isEmpty():
        # heads: boxes that still suppress and that nothing open suppresses
        end = lambda t, c: t.select("page_idx", F.col(c).alias("ord")).distinct()
        heads = end(rivals, "better").join(end(rivals, "worse"), ["page_idx", "ord"], "left_anti")
        out = checkpointed(end(rivals.join(heads.withColumnRenamed("ord", "better"), ["page_idx", "better"], "left_semi"), "worse"))
        gone = gone.unionByName(out)
        for c in ("better", "worse"):
            rivals = rivals.join(out.withColumnRenamed("ord", c), ["page_idx", c], "left_anti")
        rivals = checkpointed(rivals)  # rows of a head went with their losers
    return gone


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is first by the columns of ``order``, ascending; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def arbitrate(proposals: DataFrame, key: list[str]) -> DataFrame:
    """The winning proposal per key: eligible ones first, then score and priority (to 6 digits), strategy and id, all descending."""
    best = F.max_by(F.struct(*[c for c in proposals.columns if c not in key]), F.struct(F.coalesce("eligible", F.lit(True)), F.round("score", 6), F.round("priority", 6), "strategy", "id"))
    return proposals.groupBy(*key).agg(best.alias("_b"), F.count(F.lit(1)).alias("proposals")).select(*key, "_b.*", "proposals")


def mode_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value per key, the one seen first among equals."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    return counted.groupBy(*keys).agg(F.max_by(F.col(value), F.struct("_n", -F.col("_o"))).alias(value))


def strips(boxes: DataFrame, max_gap: float) -> DataFrame:
    """Boxes of a page in order of x, cut into runs where the next begins more than ``max_gap`` past all before: ``run`` counts from 1."""
    by = Window.partitionBy("page_idx").orderBy("x0", "ord")
    reach = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return boxes.withColumn("_cut", F.when(F.col("x0") > reach + max_gap, 1).otherwise(0)).withColumn("run", F.sum("_cut").over(by.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_cut")


#: Share of a drawing that a text must cover to lie over it.
OVER_TEXT = 0.08


def over_text(visuals: DataFrame, texts: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """``visuals`` with ``over_text``: a text covers 8 % of it, or it holds the page's centre. Body texts count (``texts.body``), any where a page has none."""
    bodies = texts.groupBy("page_idx").agg(F.bool_or("body").alias("_bodies"))
    counted = texts.join(bodies, "page_idx").where("body OR NOT _bodies").select("page_idx", "x0", "y0", "x1", "y1")
    key = ["page_idx", "ord"]
    met = box_join(visuals.select(*key, "x0", "y0", "x1", "y1"), counted, where=cover_of_first("a_", "b_") >= OVER_TEXT).select("page_idx", F.col("a_ord").alias("ord")).distinct().withColumn("_met", F.lit(True))
    centre = F.lit(page_w / 2).between(F.col("x0"), F.col("x1")) & F.lit(page_h / 2).between(F.col("y0"), F.col("y1"))
    return visuals.join(met, key, "left").withColumn("over_text", F.coalesce("_met", F.lit(False)) | centre).drop("_met")


def repeated_templates(boxes: DataFrame, key: Column, document: str, pages: DataFrame, least_share: float = 0.6) -> DataFrame:
    """Atoms that repeat at one place over a document's pages: at least min(5, max(3, ceil(0.3 pages))) times; vectors also over text in ``least_share`` of the cases.

    ``boxes`` has ``kind`` and ``over_text``; ``pages`` maps pages to documents. Keys are counted before they are joined back.
    """
    sized = pages.groupBy(document).agg(F.count(F.lit(1)).alias("_pages"))
    keyed = boxes.join(pages.select("page_idx", document), "page_idx").withColumn("_key", key)
    often = keyed.groupBy(document, "kind", "_key").agg(F.count(F.lit(1)).alias("_n"), F.count_if("over_text").alias("_over")).join(sized, document)
    limit = F.least(F.lit(5), F.greatest(F.lit(3), F.ceil(F.col("_pages") * 0.3)))
    often = often.where((F.col("_n") >= limit) & ((F.col("kind") != "vector_cluster") | (F.col("_over") / F.col("_n") >= least_share)))
    return keyed.join(often.select(document, "kind", "_key"), [document, "kind", "_key"], "left_semi").drop("_key")
