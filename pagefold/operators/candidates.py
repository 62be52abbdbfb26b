"""Figure candidates: drawings, composites, image dedupe, raster strips, boundary proposals and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions.geometry import area, clipped, cover_of_smaller, edges_touched, height, inter_area, iou, width, zero
from pagefold.operators.boxjoin import box_join
from pagefold.operators.groups import arbitrate, losers, page_clusters, suppress
from pagefold.plans.partitioning import ordered_positions
from pagefold.plans.shared import stored

# Sizes in points that the rules compare with.
BORDER_WIDTH, BORDER_HEIGHT = 80.0, 80.0
BAND_WIDTH, BAND_HEIGHT, BAND_ASPECT = 80.0, 12.0, 2.0
CLUSTER_WIDTH, CLUSTER_HEIGHT, SLENDER_LONG, SLENDER_SHORT, SLENDER_ASPECT = 24.0, 24.0, 80.0, 8.0, 4.0
IMAGE_AREA, COMPOSITE_GAP, COMPOSITE_MEMBERS, EDGE = 64.0, 12.0, 3, 12.0
IMAGE_SAME, IMAGE_COVERED = 0.95, 0.98
FRAGMENT_AREA, COMPOSITE_SHARE, COMPOSITE_SAME = 16.0, 0.75, 0.95
DENSE_FILLS, DENSE_AREA = 6, 900.0


def drawing_kind(dashed: Column, filled: Column, box: str = "") -> Column:
    """panel_border, color_band, vector_cluster or null, the first that fits."""
    w, h = zero(width(box)), zero(height(box))
    long, short = F.greatest(w, h), F.least(w, h)
    slender = (short >= SLENDER_SHORT) & (long >= SLENDER_LONG) & (long / F.greatest(short, F.lit(1.0)) >= SLENDER_ASPECT)
    return (
        F.when(dashed & (w >= BORDER_WIDTH) & (h >= BORDER_HEIGHT), "panel_border")
        .when(filled & (w >= BAND_WIDTH) & (h >= BAND_HEIGHT) & (w / F.greatest(h, F.lit(1.0)) >= BAND_ASPECT), "color_band")
        .when((w >= CLUSTER_WIDTH) & (h >= CLUSTER_HEIGHT), "vector_cluster")
        .when(slender, "vector_cluster")
    )


def stroke_orientation(stroke: Column, box: str = "") -> Column:
    """horizontal or vertical for a stroke of 80 points or more that is slender for its width."""
    limit = F.greatest(F.lit(6.0), F.coalesce(stroke, F.lit(0.0)) * 4)
    w, h = zero(width(box)), zero(height(box))
    return F.when((w >= 80) & (h <= limit), "horizontal").when((h >= 80) & (w <= limit), "vertical")


def composite_fragment(kind: Column, drawing: Column, filled: Column, orientation: Column, page_w: float, page_h: float) -> Column:
    """What a drawing may add to a composite: ``fill``, ``horizontal`` or ``vertical`` (a stroke, ``drawing`` s), null for nothing.

    Borders and bands add nothing; nor do fills that are tiny, cover most of the page or touch three of its edges.
    ``orientation`` is ``stroke_orientation`` of the drawing; the box is clipped to the page first.
    """
    box = clipped("", page_w, page_h)
    fill = filled & (area(box) > 0)
    good = (area(box) >= FRAGMENT_AREA) & (area(box) / (page_w * page_h) < COMPOSITE_SHARE) & (edges_touched(box, page_w, page_h, EDGE) < 3)
    plain = ~F.coalesce(kind.isin("panel_border", "color_band"), F.lit(False))
    return F.when(plain, F.when(fill, F.when(good, "fill")).when(drawing == "s", orientation))


def composites(fragments: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Clusters of three or more fragments at gaps of 12 points, with counts by orientation and fill.

    ``fragments`` has ``orientation`` (null: none) and ``filled``. Without a fill a composite needs three horizontal and
    two vertical strokes, with one two strokes, unless it is a dense one: six fills or more, all but one member at most,
    and 900 square points. Page-sized ones, those at three edges and those under 24 points fall out, and so does one
    that nearly equals an earlier one (from above, then from the left).
    """
    member = page_clusters(fragments, COMPOSITE_GAP)
    joined = fragments.join(member, ["page_idx", "ord"])
    grouped = joined.groupBy("page_idx", "cluster").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("orientation") == "horizontal").alias("horizontal"), F.count_if(F.col("orientation") == "vertical").alias("vertical"), F.count_if("filled").alias("fills"),
        F.min(F.struct("y0", "x0", "ord")).alias("_first"),
    )
    box = dict(zip(("x0", "y0", "x1", "y1"), clipped("", page_w, page_h), strict=True))
    inside = grouped.withColumns(box).where(F.col("members") >= COMPOSITE_MEMBERS)
    strokes = F.col("horizontal") + F.col("vertical")
    dense = (F.col("fills") >= DENSE_FILLS) & (F.col("fills") >= F.col("members") - 1) & (area("") >= DENSE_AREA)
    good = F.when(F.col("fills") > 0, (strokes >= 2) | dense).otherwise((F.col("horizontal") >= 3) & (F.col("vertical") >= 2))
    large = (width("") >= CLUSTER_WIDTH) & (height("") >= CLUSTER_HEIGHT)
    found = inside.where((area("") > 0) & (area("") / (page_w * page_h) < COMPOSITE_SHARE) & (edges_touched("", page_w, page_h, EDGE) < 3) & good & large)
    found = found.withColumn("ord", F.col("cluster"))
    return suppress(found, [F.col("_first").asc()], COMPOSITE_SAME, 1.0).where("kept").drop("kept", "ord", "_first")


def distinct_images(images: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Images clipped to the page, of 64 square points or more. Those of the text dictionary all stay; one found by
    ``xref`` goes if one that stayed before it nearly equals it (IoU above 0.95 or 98 % of the smaller covered).

    Images of the text dictionary come first, then by ``ord``. Only near pairs are joined; rounds settle them.
    """
    box = dict(zip(("x0", "y0", "x1", "y1"), clipped("", page_w, page_h), strict=True))
    seen = stored(images.withColumns(box).where(area("") >= IMAGE_AREA))
    slim = seen.select("page_idx", "ord", "x0", "y0", "x1", "y1", (F.col("source") == "xref").alias("late"))
    before = F.col("b_late") & (F.struct("a_late", "a_ord") < F.struct("b_late", "b_ord"))
    same = (iou("a_", "b_") > IMAGE_SAME) | (cover_of_smaller("a_", "b_") > IMAGE_COVERED)
    rivals = box_join(slim, slim, where=before & same).select("page_idx", F.col("a_ord").alias("better"), F.col("b_ord").alias("worse"))
    return seen.join(losers(rivals), ["page_idx", "ord"], "left_anti")


def raster_strips(rasters: DataFrame, *keys: str) -> DataFrame:
    """Groups of two or more rasters that form one column or row.

    Tight together (union at most 1.35 of their areas), edges aligned within a fifth of the median size (8 points at
    least); each box lies within a quarter of the median extent (24 points at least) of the one before and overlaps it
    across by 80 %.
    """
    median = lambda c: F.percentile(c, 0.5)

    def before(order: str, c: str) -> Column:
        return F.lag(c).over(Window.partitionBy(*keys).orderBy(order, "ord"))

    def across(order: str, lo: str, hi: str) -> Column:
        low, high = before(order, lo), before(order, hi)
        shared = F.least(F.col(hi), high) - F.greatest(F.col(lo), low)
        return F.when(low.isNotNull(), shared / F.greatest(F.least(F.col(hi) - F.col(lo), high - low), F.lit(1.0)))

    spaced = rasters.withColumns({"_gx": F.col("x0") - before("x0", "x1"), "_gy": F.col("y0") - before("y0", "y1"), "_cx": across("x0", "y0", "y1"), "_cy": across("y0", "x0", "x1")})
    s = spaced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum(area("")).alias("_sum"), median(width("")).alias("_w"), median(height("")).alias("_h"),
        *[(F.max(c) - F.min(c)).alias(f"_d{c}") for c in ("x0", "x1", "y0", "y1")],
        F.max(F.abs("_gx")).alias("_gx"), F.max(F.abs("_gy")).alias("_gy"), F.min("_cx").alias("_cx"), F.min("_cy").alias("_cy"),
    )
    aligned = lambda c, size: (F.col(f"_d{c}0") <= F.greatest(F.lit(8.0), size * 0.2)) & (F.col(f"_d{c}1") <= F.greatest(F.lit(8.0), size * 0.2))
    close = lambda c, size: (F.col(f"_g{c}") <= F.greatest(F.lit(24.0), size * 0.25)) & (F.col(f"_c{c}") >= 0.8)
    column, row = aligned("x", F.col("_w")) & close("y", F.col("_h")), aligned("y", F.col("_h")) & close("x", F.col("_w"))
    tight = (F.col("members") >= 2) & (F.col("_sum") > 0) & (area("") / F.col("_sum") <= 1.35)
    return s.where(tight & (column | row)).select(*keys, "members", "x0", "y0", "x1", "y1", F.when(column, "column").otherwise("row").alias("strip"))


# Bonus of each strategy and weights of the score.
PROPOSAL = {"kept": 0.7, "text": 0.2, "compact": 0.1, "least": 0.95, "lost": 2.0}
STRATEGIES = {"support_bbox": 0.0, "single_raster_core": 0.12, "visual_atom_union": 0.05}


def boundary_proposals(supports: DataFrame, atoms: DataFrame) -> DataFrame:
    """Proposed boxes per support box with their scores: the support, the union of its visuals, its only raster.

    A score weighs visuals kept by 0.7, text left out by 0.2 and compactness by 0.1, loses twice what visuals fall
    short of 95 %, gains the strategy's bonus, and lies in 0 to 1. Atoms belong to a support box that contains their centre.
    """
    box = ("x0", "y0", "x1", "y1")
    cx, cy = (F.col("b_x0") + F.col("b_x1")) / 2, (F.col("b_y0") + F.col("b_y1")) / 2
    inside = cx.between(F.col("a_x0"), F.col("a_x1")) & cy.between(F.col("a_y0"), F.col("a_y1"))
    held = box_join(supports.select("page_idx", "ord", *box), atoms.select("page_idx", "ord", "kind", *box), where=inside)
    visual = F.col("b_kind") != "text_block"
    per = held.groupBy("page_idx", F.col("a_ord").alias("ord")).agg(
        F.count_if(visual).alias("_v"), F.count_if(F.col("b_kind") == "raster_image").alias("_r"),
        *[f(F.when(visual, F.col(f"b_{c}"))).alias(f"_u_{c}") for c, f in zip(box, (F.min, F.min, F.max, F.max), strict=True)],
        *[F.max(F.when(F.col("b_kind") == "raster_image", F.col(f"b_{c}"))).alias(f"_c_{c}") for c in box],
    )
    base = supports.select("page_idx", "ord", *box).join(per, ["page_idx", "ord"], "left")
    made = lambda name, p: F.struct(F.lit(name).alias("strategy"), *[F.col(f"{p}{c}").alias(c) for c in box])
    options = F.array_compact(F.array(made("support_bbox", ""), F.when(F.col("_v") > 0, made("visual_atom_union", "_u_")), F.when(F.col("_r") == 1, made("single_raster_core", "_c_"))))
    proposals = base.select("page_idx", "ord", *[F.col(c).alias(f"s_{c}") for c in box], F.explode(options).alias("p")).select("page_idx", "ord", *[f"s_{c}" for c in box], "p.*")
    members = held.select("page_idx", F.col("a_ord").alias("ord"), visual.alias("_visual"), *[F.col(f"b_{c}").alias(f"m_{c}") for c in box])
    part = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0))
    is_v = F.col("_visual")
    sums = proposals.join(members, ["page_idx", "ord"], "left").groupBy("page_idx", "ord", "strategy", *box, *[f"s_{c}" for c in box]).agg(
        part(is_v, area("m_")).alias("_va"), part(~is_v, area("m_")).alias("_ta"), part(is_v, inter_area("", "m_")).alias("_vi"), part(~is_v, inter_area("", "m_")).alias("_ti")
    )
    keep = F.when(F.col("_va") > 0, F.col("_vi") / F.col("_va")).otherwise(F.lit(1.0))
    text = F.when(F.col("_ta") > 0, F.col("_ti") / F.col("_ta")).otherwise(F.lit(0.0))
    compact = F.when(area("s_") > 0, zero(1 - area("") / area("s_"))).otherwise(F.lit(0.0))
    bonus = F.coalesce(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv])[F.col("strategy")], F.lit(0.0))
    w = PROPOSAL
    score = w["kept"] * keep + w["text"] * (1 - text) + w["compact"] * compact - zero(w["least"] - keep) * w["lost"] + bonus
    return sums.select("page_idx", "ord", "strategy", *box, F.round(F.least(F.lit(1.0), zero(score)), 4).alias("score"))


def calibrated(proposals: DataFrame) -> DataFrame:
    """The winning proposal of each support box."""
    named = proposals.withColumns({"id": F.col("strategy"), "priority": F.lit(0.0), "eligible": F.lit(True)})
    return arbitrate(named, ["page_idx", "ord"]).select("page_idx", "ord", "strategy", "x0", "y0", "x1", "y1", "score", "proposals")


def primitive_groups(primitives: DataFrame) -> DataFrame:
    """Primitives of a page by group id: union box, kinds in order, members, and the operator all share (null otherwise)."""
    shared = F.when((F.min("operator") == F.max("operator")) & (F.count("operator") == F.count(F.lit(1))), F.min("operator"))
    return primitives.groupBy("page_idx", "group_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("members"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), shared.alias("operator"))


# The most that a seed of each kind of evidence counts, and how covering over a quarter of the page costs.
SEED_CAPS = {"layout_column": 0.8, "image_cluster": 0.65, "image_seed": 0.45, "captioned_image_seed": 0.4, "caption_anchor_visual": 0.55, "visual_community": 0.35, "seed_free_compact_visual": 0.18, "seed_free_isolated_visual": 0.12, "border": 0.35}
OTHER_CAP = 0.5
COVERED = 0.25
LEVELS = {"L0": 0.0, "L1": 0.1, "L2": 0.2}
RICHNESS = {"nodes": 0.2, "atoms": 0.12}
PENALTIES = {"supported": 1.2, "multi": 0.9}
COVERAGE_COSTS = {"visual_community": 2.0, "seed_free_compact_visual": 2.4}


def _of(table: dict[str, float], key: Column, other: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(other))


def closure_scores(closures: DataFrame, page_area: float) -> DataFrame:
    """Scores of closures ``page_idx, seed, nodes, atoms, evidence, seed_score, level, multi, captions, supported`` with a box; best first on a page as ``rank``.

    The capped score of the seed, richness by nodes and atoms, the bonus of the level, less the cost of covering too
    much of the page, of a visual community without caption that a compact group of the same elements supports
    (``supported``), and of spanning several captions (``multi``). Empty boxes fall out. Ranks come from a range sort.
    """
    kind = F.coalesce("evidence", F.lit(""))
    rich = F.round(F.log1p("nodes") * RICHNESS["nodes"] + F.log1p("atoms") * RICHNESS["atoms"], 4)
    cost = zero(area("") / page_area - COVERED) * _of(COVERAGE_COSTS, kind, 0.0)
    support = F.when((kind == "visual_community") & (F.col("captions") == 0) & F.col("supported"), PENALTIES["supported"]).otherwise(F.lit(0.0))
    span = F.when(F.col("multi"), PENALTIES["multi"]).otherwise(F.lit(0.0))
    score = F.round(F.least(F.col("seed_score"), _of(SEED_CAPS, kind, OTHER_CAP)) + rich + _of(LEVELS, F.col("level"), 0.0) - cost - support - span, 4)
    scored = closures.where(area("") > 0).withColumn("score", score)
    return ordered_positions(scored, "page_idx", [F.col("score").desc(), F.col("seed").asc()]).withColumn("rank", (F.col("group_pos") + 1).cast("int")).drop("group_pos")


def lifecycle(events: DataFrame, chosen: DataFrame, stage: str, reason: str, threshold: float) -> DataFrame:
    """One event per candidate of a stage, with its ``score``: selected if chosen, else suppressed for a reason; ``threshold`` is what the stage compared with."""
    picked = chosen.select("page_idx", "ord").withColumn("_on", F.lit(True))
    on = F.coalesce("_on", F.lit(False))
    named = {"stage": F.lit(stage), "decision": F.when(on, "selected").otherwise("suppressed"), "reason": F.when(~on, reason), "threshold": F.lit(threshold)}
    return events.join(picked, ["page_idx", "ord"], "left").select("page_idx", "ord", *[c.alias(n) for n, c in named.items()], "score")
