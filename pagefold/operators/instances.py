"""Figure instances: groups of rasters, seeds without panels, object scores, duplicates and the best complete boundary.

All relations are range joins within a page; groups are components over all pages at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.geometry import Box, area, aspect, cover_of_smaller, edges_touched, gap, height, iou, overlap_x, overlap_y, padded, sides, width, zero
from pagefold.functions.scores import trims
from pagefold.functions.visuals import is_background, is_edge_tiny, is_nested_peer, is_subordinate_peer
from pagefold.operators.annotations import FIGURE_CAPTION
from pagefold.operators.boxjoin import box_join, self_pairs
from pagefold.operators.groups import linked_groups, losers
from pagefold.plans.partitioning import ordered_positions
from pagefold.plans.shared import checkpointed, stored

BOX = ("x0", "y0", "x1", "y1")
# Rasters of one group, in shares of the smaller and points.
GROUP_OVERLAP, GROUP_CENTRE, GROUP_CENTRE_LEAST = 0.55, 0.16, 12.0
GROUP_STACK, GROUP_STACK_LEAST, GROUP_BESIDE, GROUP_BESIDE_LEAST = 0.35, 18.0, 0.2, 24.0
CAPTION_BETWEEN, CAPTION_SLACK = 0.2, 2.0
# Seeds without panels.
FREE_GAP, FREE_GAP_LEAST = 2.5, 18.0
LONE = {"least": 0.001, "raster": 0.08, "vector": 0.12, "raster_aspect": 4.0, "vector_aspect": 6.0, "pad": 0.8, "pad_least": 8.0, "pad_most": 18.0, "raster_score": 0.18, "vector_score": 0.16}
COMPACT = {"pad": 2.0, "pad_least": 12.0, "pad_most": 40.0, "share": 0.12, "vector_share": 0.22, "vector_aspect": 3.5, "edge_aspect": 4.0, "score": 0.22, "member": 0.02}
# Duplicates, and the weights of object and content scores.
SAME_IOU, SAME_MEMBERS, SAME_COVER = 0.95, 0.9, 0.75
OBJECT = {"anchor": 0.3, "purity": 0.15, "boundary": 0.2, "area": 0.15, "mass": 0.2, "localized": 0.35, "excluded": 0.15, "localized_most": 0.8, "primitive": 0.08, "primitive_most": 0.35, "carrier": 0.8, "carrier_most": 1.0}
BRANCH = {"base": 1.0, "gain": 0.9, "evidence": 0.08, "coarse": 0.04, "excluded": 0.25, "mass": 0.25, "primitive": 0.45, "many": 0.1, "pixel": 0.12, "thin": 0.35, "thin_cost": 2.0}
PROMOTE = {"ratio": 0.78, "cover": 0.98, "trim": 0.03, "trims": 0.12}
QUALITY = {"table": 0.55, "multi": 0.6, "raster": 0.78, "coarse": 0.3, "primitive": 0.18, "region": 0.5, "other": 0.25}
SINGLE_UNION, SINGLE = 0.75, 0.78


def raster_groups(images: DataFrame, texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """``page_idx, ord, cluster``: images that look like one figure: aligned and near, of no two figure numbers, with no caption between.

    ``numbers`` has ``page_idx, ord, number`` of images that have one.
    """
    known = stored(images.select("page_idx", "ord", *BOX).join(numbers, ["page_idx", "ord"], "left"))
    one = lambda f: F.greatest(F.lit(1.0), F.least(f("a_"), f("b_")))
    dx, dy = zero(-overlap_x("a_", "b_")), zero(-overlap_y("a_", "b_"))
    centre = lambda lo, hi: F.abs((F.col(f"a_{lo}") + F.col(f"a_{hi}")) / 2 - (F.col(f"b_{lo}") + F.col(f"b_{hi}")) / 2)
    in_line = lambda o, lo, hi, f: (zero(o("a_", "b_")) / one(f) >= GROUP_OVERLAP) | (centre(lo, hi) <= F.greatest(F.lit(GROUP_CENTRE_LEAST), one(f) * GROUP_CENTRE))
    stacked = in_line(overlap_x, "x0", "x1", width) & (dy <= F.greatest(F.lit(GROUP_STACK_LEAST), one(height) * GROUP_STACK))
    beside = in_line(overlap_y, "y0", "y1", height) & (dx <= F.greatest(F.lit(GROUP_BESIDE_LEAST), one(width) * GROUP_BESIDE))
    apart = F.coalesce(F.col("a_number") != F.col("b_number"), F.lit(False))
    links = checkpointed(self_pairs(known, reach=(F.greatest(F.lit(GROUP_BESIDE_LEAST), width("a_") * GROUP_BESIDE), F.greatest(F.lit(GROUP_STACK_LEAST), height("a_") * GROUP_STACK)), where=(stacked | beside) & ~apart))
    captions = texts.where(F.regexp_count("text", F.lit(FIGURE_CAPTION)) > 0).select("page_idx", *BOX)
    return linked_groups(known, links.join(_caption_between(links, captions), ["page_idx", "a_ord", "b_ord"], "left_anti"))


def _caption_between(pairs: DataFrame, captions: DataFrame) -> DataFrame:
    """Pairs one above the other with a caption whose middle lies between, over a fifth of their common width."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = sides("a_"), sides("b_")
    top = F.when(ay1 <= by0, ay1).when(by1 <= ay0, by1)
    bottom = F.when(ay1 <= by0, by0).when(by1 <= ay0, ay0)
    spans = pairs.select("page_idx", "a_ord", "b_ord", F.least(ax0, bx0).alias("x0"), (top - CAPTION_SLACK).alias("y0"), F.greatest(ax1, bx1).alias("x1"), (bottom + CAPTION_SLACK).alias("y1"))
    spans = spans.where("y1 - y0 > 4")
    middle = (F.col("b_y0") + F.col("b_y1")) / 2
    inside = middle.between(F.col("a_y0"), F.col("a_y1")) & (zero(overlap_x("a_", "b_")) / F.greatest(F.lit(1.0), width("a_")) >= CAPTION_BETWEEN)
    return box_join(spans, captions, where=inside).select("page_idx", F.col("a_a_ord").alias("a_ord"), F.col("a_b_ord").alias("b_ord")).distinct()


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def lone_visuals(visuals: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Seeds of small visuals that stand alone: ``page_idx, source``, a padded box, ``members`` and ``score``.

    ``visuals`` are images and drawings with ``text_height``, the median height of the page's text blocks. Backgrounds
    and tiny ones at an edge fall out; a drawing must have no neighbour but nested and subordinate ones.
    """
    share = area("") / max(page_w * page_h, 1.0)
    front = stored(visuals.where(~is_background("", page_w, page_h, True)))
    slim = front.select("page_idx", "ord", *BOX, "text_height")
    reach = F.greatest(F.lit(FREE_GAP_LEAST), F.col("a_text_height") * FREE_GAP)
    peers = (F.col("a_ord") != F.col("b_ord")) & ~is_nested_peer("a_", "b_") & ~is_subordinate_peer("a_", "b_") & (gap("a_", "b_") <= reach)
    near = box_join(slim, slim.drop("text_height"), reach=reach, where=peers).select("page_idx", F.col("a_ord").alias("ord")).distinct().withColumn("_near", F.lit(True))
    raster = F.col("kind") == "raster_image"
    pick = lambda name: F.when(raster, LONE[f"raster{name}"]).otherwise(F.lit(LONE[f"vector{name}"]))
    ok = ~is_edge_tiny("", page_w, page_h) & (raster | F.col("_near").isNull()) & (share >= LONE["least"]) & (share <= pick("")) & (aspect("") <= pick("_aspect"))
    box = padded("", _clamp(F.col("text_height") * LONE["pad"], LONE["pad_least"], LONE["pad_most"]), page_w, page_h)
    return front.join(near, ["page_idx", "ord"], "left").where(ok).select("page_idx", F.col("ord").alias("source"), *[c.alias(n) for n, c in zip(BOX, box, strict=True)], F.lit(1).cast("bigint").alias("members"), pick("_score").alias("score"))


def compact_visuals(visuals: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Seeds of groups of two or more near visuals, in the form of ``lone_visuals``; too large or slender ones at an edge fall out."""
    front = stored(visuals.where(~is_background("", page_w, page_h, True) & ~is_edge_tiny("", page_w, page_h)))
    reach = F.greatest(F.lit(FREE_GAP_LEAST), F.col("a_text_height") * FREE_GAP)
    links = self_pairs(front.select("page_idx", "ord", *BOX, "text_height"), reach=reach, where=gap("a_", "b_") <= reach)
    joined = front.join(linked_groups(front, links), ["page_idx", "ord"])
    per = joined.groupBy("page_idx", F.col("cluster").alias("source")).agg(*[f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)], F.count(F.lit(1)).alias("members"), F.bool_and(F.col("kind") == "vector_cluster").alias("_vectors"), F.first("text_height").alias("_h"))
    box = padded("", _clamp(F.col("_h") * COMPACT["pad"], COMPACT["pad_least"], COMPACT["pad_most"]), page_w, page_h)
    grown = per.where("members >= 2").withColumns(dict(zip(BOX, box, strict=True)))
    edges = edges_touched("", page_w, page_h, 12.0)
    most = F.when(F.col("_vectors") & (edges == 0) & (aspect("") <= COMPACT["vector_aspect"]), COMPACT["vector_share"]).otherwise(F.lit(COMPACT["share"]))
    good = (area("") / max(page_w * page_h, 1.0) <= most) & ~((edges >= 1) & (aspect("") >= COMPACT["edge_aspect"]))
    return grown.where(good).select("page_idx", "source", *BOX, "members", (F.lit(COMPACT["score"]) + F.col("members") * COMPACT["member"]).alias("score"))


def free_seeds(visuals: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Both kinds of seeds without panels with ``evidence`` and their ``place`` on the page by score."""
    lone = lone_visuals(visuals, page_w, page_h).withColumn("evidence", F.lit("seed_free_isolated_visual"))
    both = lone.unionByName(compact_visuals(visuals, page_w, page_h).withColumn("evidence", F.lit("seed_free_compact_visual")))
    placed = ordered_positions(both, "page_idx", [F.round("score", 6).desc(), F.col("evidence").asc(), F.col("source").asc()])
    return placed.withColumn("place", F.col("group_pos") + 1).drop("group_pos")


def object_score(anchors: Column, anchors_owned: Column, owned: Column, excluded: Column, owned_area: Column, support: Box, boundary: Column, kind: Column, carriers: Column, primitives: Column) -> Column:
    """The score of an object: anchors kept, purity, boundary, area and mass, times the root of what it owns, with what its kind gains or costs."""
    w = OBJECT
    kept = F.when(anchors > 0, anchors_owned / anchors).otherwise(F.lit(0.0))
    pure = F.when(owned > 0, owned / F.greatest(F.lit(1), owned + excluded)).otherwise(F.lit(0.0))
    share = F.when(area(support) > 0, F.least(F.lit(1.0), owned_area / area(support))).otherwise(F.lit(0.0))
    mass = F.sqrt(owned.cast("double"))
    base = kept * w["anchor"] + pure * w["purity"] + boundary * w["boundary"] + share * w["area"] + F.least(F.lit(1.0), mass / 2.0) * w["mass"]
    gain = F.when((kind == "localized") & (excluded > 0), F.least(F.lit(w["localized_most"]), w["localized"] + excluded * w["excluded"])).when(kind == "primitive_localized", F.least(F.lit(w["primitive_most"]), F.greatest(F.lit(1), primitives) * w["primitive"]))
    cost = F.when((kind == "compound") & (carriers > 0), F.least(F.lit(w["carrier_most"]), carriers * w["carrier"]))
    return F.round(zero(base * F.greatest(F.lit(1.0), mass) + F.coalesce(gain, F.lit(0.0)) - F.coalesce(cost, F.lit(0.0))), 4)


def branch_score(support: Box, content: Box, owned: Column, excluded: Column, evidence: Column, coarse: Column, primitive_only: Column, pixels: Column, bonus: Column) -> Column:
    """The score of a content branch: how much it compresses its support, its evidence, exclusions and mass; thin ones cost."""
    w, ratio = BRANCH, area(content) / area(support)
    num = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    known = area(support) > 0
    gain = F.when(known, zero(1 - ratio)).otherwise(F.lit(0.0))
    left_out = F.when(excluded > 0, excluded / F.greatest(F.lit(1), owned + excluded)).otherwise(F.lit(0.0))
    parts = w["base"] + bonus + gain * w["gain"] + F.least(evidence, F.lit(12)) * w["evidence"] + F.least(coarse, F.lit(6)) * w["coarse"] + left_out * w["excluded"] + F.least(F.sqrt(owned.cast("double")), F.lit(2.0)) * w["mass"]
    more = num(primitive_only, w["primitive"]) + num(primitive_only & (evidence >= 12), w["many"]) + num(pixels, w["pixel"])
    thin = F.when(known & (ratio < w["thin"]), (w["thin"] - ratio) * w["thin_cost"]).otherwise(F.lit(0.0))
    return F.round(zero(parts + more - thin), 4)


def promotion_score(support: Box, content: Box, barred: Column) -> Column:
    """Above 0 a content box covers its support so well that the support takes its place; -1 where that is ``barred`` or a box is empty."""
    w, t = PROMOTE, trims(support, content)
    most, total = F.greatest(*t.values()), t["left"] + t["top"] + t["right"] + t["bottom"]
    score = (area(content) / area(support) - w["ratio"]) * 4.0 + (cover_of_smaller(content, support) - w["cover"]) * 1.5 - zero(most - w["trim"]) * 4.0 - zero(total - w["trims"]) * 1.5
    return F.when(barred | (area(support) <= 0) | (area(content) <= 0), F.lit(-1.0)).otherwise(score)


def has_figure_quality(support: Box, content: Box, strategy: Column, source: Column, tables: Column, multi: Column, primitive_only: Column) -> Column:
    """A content branch that covers enough of its support for its source to stand for a whole figure."""
    q, ratio = QUALITY, area(content) / area(support)
    pixels = source.isin("raster_pixel_content", "raster_background_difference")
    least = (
        F.when(source == "raster_split_proposal", 0.0)
        .when((strategy == "raster_content_branch") | pixels, F.when(tables, q["table"]).when(pixels & multi, q["multi"]).otherwise(q["raster"]))
        .when((strategy == "coarse_nonraster_decomposition") | (source == "nonraster_content_decomposition_helper"), q["coarse"])
        .when(primitive_only, q["primitive"])
        .when(source == "primitive_evidence_region", q["region"])
        .otherwise(q["other"])
    )
    return (area(support) > 0) & (area(content) > 0) & (ratio >= least)


def keeps_single_raster(support: Box, content: Box, source: Column) -> Column:
    """A content box of one raster that is worth a hypothesis of its own."""
    ratio = area(content) / area(support)
    return (area(support) > 0) & (area(content) > 0) & F.when(source == "raster_anchor_union", ratio <= SINGLE_UNION).when(source == "raster_split_proposal", True).otherwise(ratio >= SINGLE)


def distinct_instances(instances: DataFrame) -> DataFrame:
    """Instances without duplicates of better ones: by score, then id, one goes if one that stays has nearly its box, or nine tenths of the visuals of the smaller and three quarters of its area.

    ``instances`` has ``page_idx, ord`` (the id), ``score, visuals`` (a list of ids) and a box.
    """
    shared = F.size(F.array_intersect("a_visuals", "b_visuals")) / F.greatest(F.lit(1), F.least(F.size("a_visuals"), F.size("b_visuals")))
    alike = (F.size("a_visuals") > 0) & (F.size("b_visuals") > 0) & (shared >= SAME_MEMBERS) & (cover_of_smaller("a_", "b_") >= SAME_COVER)
    better = F.struct((-F.col("a_score")).alias("s"), F.col("a_ord").alias("o")) < F.struct((-F.col("b_score")).alias("s"), F.col("b_ord").alias("o"))
    known = stored(instances)
    pairs = box_join(known, known, where=(F.col("a_ord") != F.col("b_ord")) & better & ((iou("a_", "b_") > SAME_IOU) | alike))
    gone = losers(pairs.select("page_idx", F.col("a_ord").alias("better"), F.col("b_ord").alias("worse")))
    return known.join(gone, ["page_idx", "ord"], "left_anti")


def best_boundaries(candidates: DataFrame, *keys: str) -> DataFrame:
    """The candidate of each group with the surest boundary: confidence, object score, area, id, all descending; combined before the shuffle."""
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("confidence", "object_score", area("").alias("_a"), "id")).alias("_b")).select(*keys, "_b.*")


