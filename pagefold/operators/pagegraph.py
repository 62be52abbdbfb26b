"""Relations between boxes of a page: containment, captions, rows and columns, barriers, attachment, closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.geometry import area, cover_of_smaller, height, overlap_x, overlap_y, same_column, same_row, width
from pagefold.operators.boxjoin import box_join
from pagefold.plans.shared import checkpointed

# Gaps in points and shares that the relations use.
NEAR_TEXT_GAP, ATTACH_GAP, CAPTION_OVERLAP, CONTAIN_TOLERANCE = 80.0, 40.0, 0.35, 2.0


def contained(outer: DataFrame, inner: DataFrame, tolerance: float = CONTAIN_TOLERANCE) -> DataFrame:
    """``page_idx, source, target``: inner boxes within an outer one, up to ``tolerance``; a box doesn't hold itself."""
    a0, b0 = F.col("a_x0") - tolerance, F.col("b_x0")
    inside = (b0 >= a0) & (F.col("b_y0") >= F.col("a_y0") - tolerance) & (F.col("b_x1") <= F.col("a_x1") + tolerance) & (F.col("b_y1") <= F.col("a_y1") + tolerance)
    pairs = box_join(outer, inner, reach=tolerance, where=inside & (F.col("a_ord") != F.col("b_ord")))
    return pairs.select("page_idx", F.col("a_ord").alias("source"), F.col("b_ord").alias("target"))


def below(upper: DataFrame, captions: DataFrame, max_gap: float = NEAR_TEXT_GAP) -> DataFrame:
    """Captions that begin 0 to ``max_gap`` under a box and overlap 35 % of the narrower of both."""
    over = overlap_x("a_", "b_")
    share = over / F.greatest(F.least(F.greatest(width("a_"), F.lit(1.0)), F.greatest(width("b_"), F.lit(1.0))), F.lit(1.0))
    distance = F.col("b_y0") - F.col("a_y1")
    pairs = box_join(upper, captions, reach=(0.0, max_gap), where=(over > 0) & distance.between(0, max_gap) & (share >= CAPTION_OVERLAP))
    return pairs.select("page_idx", F.col("a_ord").alias("source"), F.col("b_ord").alias("target"))


def nearest_caption(images: DataFrame, markers: DataFrame, page_height: float) -> DataFrame:
    """``page_idx, ord, number``: the number of the caption nearest below each image: least distance, then most overlap, then smallest number."""
    reach = max(96.0, page_height * 0.33)
    over = overlap_x("a_", "b_")
    ok = (over / F.greatest(F.least(width("a_"), width("b_")), F.lit(1.0)) >= 0.2) & (F.col("b_y0") >= F.col("a_y0") - F.greatest(F.lit(16.0), F.greatest(height("a_"), F.lit(1.0)) * 0.25))
    distance = F.greatest(F.col("b_y0") - F.col("a_y1"), F.lit(0.0))
    pairs = box_join(images, markers, reach=(0.0, reach), where=ok & (distance <= reach))
    return pairs.groupBy("page_idx", F.col("a_ord").alias("ord")).agg(F.min(F.struct(distance.alias("d"), (-over).alias("o"), F.col("b_number").alias("number"))).alias("m")).select("page_idx", "ord", "m.number")


def text_barriers(pairs: DataFrame, texts: DataFrame, across: float = 0.8) -> DataFrame:
    """Pairs ``page_idx, a_*, b_*`` that a text separates: it covers ``across`` of the shared width in the gap between
    upper and lower, or 60 % of the shared height between left and right. A semi join on the box that spans the gap."""
    box = lambda p: [F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")]
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = box("a_"), box("b_")
    a_up, a_left = ay0 <= by0, ax0 <= bx0
    shared = {"sx0": F.greatest(ax0, bx0), "sx1": F.least(ax1, bx1), "gy0": F.when(a_up, ay1).otherwise(by1), "gy1": F.when(a_up, by0).otherwise(ay0), "sy0": F.greatest(ay0, by0), "sy1": F.least(ay1, by1), "gx0": F.when(a_left, ax1).otherwise(bx1), "gx1": F.when(a_left, bx0).otherwise(ax0)}
    held = pairs.select("page_idx", "a_ord", "b_ord", *[c.alias(k) for k, c in shared.items()])
    gaps = held.where("gy1 > gy0 AND sx1 > sx0").select("page_idx", "a_ord", "b_ord", F.lit("v").alias("way"), F.col("sx0").alias("x0"), F.col("gy0").alias("y0"), F.col("sx1").alias("x1"), F.col("gy1").alias("y1"))
    gaps = gaps.unionByName(held.where("gx1 > gx0 AND sy1 > sy0").select("page_idx", "a_ord", "b_ord", F.lit("h").alias("way"), F.col("gx0").alias("x0"), F.col("sy0").alias("y0"), F.col("gx1").alias("x1"), F.col("sy1").alias("y1")))
    ox, oy = overlap_x("a_", "b_"), overlap_y("a_", "b_")
    stops = (ox > 0) & (oy > 0) & F.when(F.col("a_way") == "v", ox / width("a_") >= across).otherwise(oy / height("a_") >= 0.6)
    return box_join(gaps, texts.select("page_idx", "x0", "y0", "x1", "y1"), where=stops).select("page_idx", F.col("a_a_ord").alias("a_ord"), F.col("a_b_ord").alias("b_ord")).distinct()


def attachment_side(a: str, b: str, max_gap: float = ATTACH_GAP) -> Column:
    """The first side of ``a``, of bottom, top, right and left, where ``b`` lies within ``max_gap`` along half of it.

    Null if ``b`` is too large for a part at that side: over 2.5 times as wide, or over 1.5 (beside: 1.75) times as high.
    """
    ox, oy = overlap_x(a, b), overlap_y(a, b)
    aw, ah = F.greatest(width(a), F.lit(1.0)), F.greatest(height(a), F.lit(1.0))
    wide, tall = (ox > 0) & (ox / aw >= 0.5), (oy > 0) & (oy / ah >= 0.5)
    c = lambda p, s: F.col(f"{p}{s}")
    near = lambda d: d.between(0, max_gap)
    narrow = width(b) <= aw * 2.5
    over, beside = narrow & (height(b) <= ah * 1.5), narrow & (height(b) <= ah * 1.75)
    return (
        F.when(wide & near(c(b, "y0") - c(a, "y1")), F.when(over, "bottom"))
        .when(wide & near(c(a, "y0") - c(b, "y1")), F.when(over, "top"))
        .when(tall & near(c(b, "x0") - c(a, "x1")), F.when(beside, "right"))
        .when(tall & near(c(a, "x0") - c(b, "x1")), F.when(beside, "left"))
    )


def page_graph(atoms: DataFrame, panels: DataFrame, captions: DataFrame) -> DataFrame:
    """``page_idx, source, target, relation``: contains, caption_of, same_row, same_column, near_body_text and attachment_candidate.

    Rows and columns lead from the panel that comes first by (y0, x0, ord) to the later one, unless one covers 80 % of
    the other or a text stands between. Atoms that a panel holds or that are captions are neither near text nor
    attached. All relations are range joins within a page.
    """
    box = ("page_idx", "ord", "x0", "y0", "x1", "y1")
    p, a = panels.select(*box), atoms.select(*box, "kind")
    named = lambda t, r: t.select("page_idx", "source", "target", F.lit(r).alias("relation"))
    not_caption = a.join(captions.select("page_idx", "ord"), ["page_idx", "ord"], "left_anti")
    holds = checkpointed(contained(p, not_caption.select(*box)))
    first = F.struct("a_y0", "a_x0", "a_ord") < F.struct("b_y0", "b_x0", "b_ord")
    apart = ~((area("a_") > 0) & (area("b_") > 0) & (cover_of_smaller("a_", "b_") >= 0.8))
    rows = box_join(p, p, axes="y", where=first & apart & same_row("a_", "b_")).withColumn("relation", F.lit("same_row"))
    columns = box_join(p, p, axes="x", where=first & apart & same_column("a_", "b_")).withColumn("relation", F.lit("same_column"))
    lines = checkpointed(rows.unionByName(columns))
    barred = text_barriers(lines, atoms.where("kind = 'text_block'"))
    lines = lines.join(barred, ["page_idx", "a_ord", "b_ord"], "left_anti").select("page_idx", F.col("a_ord").alias("source"), F.col("b_ord").alias("target"), "relation")
    free = not_caption.join(holds.select("page_idx", F.col("target").alias("ord")), ["page_idx", "ord"], "left_anti")
    gap = lambda c: c.between(0, NEAR_TEXT_GAP)
    near = box_join(p, free.where("kind = 'text_block'").select(*box), reach=(0.0, NEAR_TEXT_GAP), where=(overlap_x("a_", "b_") > 0) & (gap(F.col("b_y0") - F.col("a_y1")) | gap(F.col("a_y0") - F.col("b_y1"))) & (F.col("a_ord") != F.col("b_ord")))
    side = attachment_side("a_", "b_")
    tied = box_join(p, free.where(F.col("kind").isin("color_band", "vector_cluster", "raster_image")).select(*box), reach=ATTACH_GAP, where=side.isNotNull() & (F.col("a_ord") != F.col("b_ord")))
    ends = lambda t: t.select("page_idx", F.col("a_ord").alias("source"), F.col("b_ord").alias("target"))
    parts = [named(holds, "contains"), named(below(p, captions.select(*box)), "caption_of"), lines, named(ends(near), "near_body_text"), named(ends(tied), "attachment_candidate")]
    return reduce(DataFrame.unionByName, parts)


# Which relations attract; the others repel.
ATTRACT = ("contains", "caption_of", "same_row", "same_column", "attachment_candidate")


def bipolar(edges: DataFrame) -> DataFrame:
    """Edges with their polarity."""
    return edges.withColumn("polarity", F.when(F.col("relation").isin(*ATTRACT), "attract").otherwise("repel"))


def closure(seeds: DataFrame, edges: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """``page_idx, seed, node, content``: nodes that a seed reaches along attracting edges whose source doesn't also repel the target.

    ``content`` is false for nodes that only captions lead to. Breadth first, one join per step on (page, node) and one
    checkpoint; a seed is among its nodes only if an edge leads back to it. Stops when a step reaches nothing new, at
    ``max_depth`` with an error.
    """
    pull = edges.where("polarity = 'attract'").select("page_idx", "source", "target", (F.col("relation") != "caption_of").alias("_content"))
    push = edges.where("polarity = 'repel'").select("page_idx", "source", "target")
    steps = pull.join(push, ["page_idx", "source", "target"], "left_anti").groupBy("page_idx", "source", "target").agg(F.bool_or("_content").alias("_content"))
    steps = checkpointed(steps.withColumnRenamed("source", "node"))
    front = reached = seeds.select("page_idx", F.col("ord").alias("seed"), F.col("ord").alias("node")).distinct()
    found = None
    for _ in range(max_depth):
        new = front.join(steps, ["page_idx", "node"]).groupBy("page_idx", "seed", F.col("target").alias("node")).agg(F.bool_or("_content").alias("_content"))
        new = new.join(reached.withColumn("_known", F.lit(True)), ["page_idx", "seed", "node"], "left")
        new = checkpointed(new)  # every edge out of the front, so content counts from all sources once they are reached
        found = new if found is None else found.unionByName(new)
        front = new.where("_known IS NULL").select("page_idx", "seed", "node")
        if front.isEmpty():
            return found.groupBy("page_idx", "seed", "node").agg(F.bool_or("_content").alias("content"))
        reached = reached.unionByName(front)
    raise RuntimeError("a closure is deeper than max_depth")
