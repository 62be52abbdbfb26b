"""Panels of a page: borders, columns of bands, large and clustered images, visual communities, what stands above captions, and their caption scopes.

Elements come as ``page_idx, ord, kind, x0, y0, x1, y1, text``, images also with ``source`` (``xref`` or another) and
``clipped``; captions as ``roles``. A panel is ``page_idx, panel_kind, source, x0, y0, x1, y1, members``. All searches
are range joins within a page; no page is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions import text as t
from pagefold.functions.geometry import area, cover_of_smaller, height, iou, overlap_x, width, zero
from pagefold.functions.visuals import hangs_over, images_meet, is_background, is_body_text, is_hero, is_large_image, is_visual, spans_page, stripped
from pagefold.operators.boxjoin import box_join, self_pairs
from pagefold.operators.groups import linked_groups, losers, page_clusters
from pagefold.operators.pagegraph import nearest_caption
from pagefold.plans.shared import stored

BOX = ("x0", "y0", "x1", "y1")
# Tolerances and gaps in points, shares and counts.
HOLD, ALIGNED, BEHIND = 2.0, 6.0, 8.0
CAPTION_GAP, SCOPE_GAP, CAPTION_INSIDE = 36.0, 48.0, 0.5
CAPTION_SURE, REFERENCE_SURE, MARKER_SURE = 0.9, 0.65, 0.65
COMMUNITY_GAP, COMMUNITY_BARRIER, COMMUNITY_MEMBERS, COMMUNITY_AREA = 60.0, 0.6, 3, 0.03
SPREAD_RATIO, SPREAD_SHARE, SAME_PANEL = 4.0, 0.35, 0.9
ANCHOR_GAP, ANCHOR_GAP_SHARE, ANCHOR_HEIGHT, ANCHOR_OVERLAP, ANCHOR_AREA, ANCHOR_COVER, ANCHOR_RATIO = 48.0, 0.08, 0.45, 0.2, 0.005, 0.8, 0.8
IMAGE_GAP = 40.0


def text_roles(atoms: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """``page_idx, ord, x0 .. y1, text, role, confidence, number, scope``: what text blocks are; ``scope`` marks those that may name a figure."""
    blocks = atoms.where("kind = 'text_block'").select("page_idx", "ord", *BOX, stripped(F.col("text")).alias("text")).where("text <> ''")
    roles = blocks.withColumn("_r", t.text_role(F.col("text"), t.is_full_width("", page_w, page_h))).where("_r IS NOT NULL")
    roles = roles.select("page_idx", "ord", *BOX, "text", "_r.role", "_r.confidence", "_r.number")
    caption = (F.col("role") == "figure_caption") & (F.col("confidence") >= CAPTION_SURE)
    reference = (F.col("role") == "body_reference") & (F.col("confidence") >= REFERENCE_SURE) & (F.length("text") >= 4) & t.starts_like_caption(F.col("text"))
    return roles.withColumn("scope", caption | reference)


def _panel(df: DataFrame, kind: str) -> DataFrame:
    return df.select("page_idx", F.lit(kind).alias("panel_kind"), "source", *BOX, F.col("members").cast("bigint").alias("members"))


def _prefixed(df: DataFrame, p: str, *more: str) -> list[Column]:
    return [F.col(f"{p}{c}").alias(c) for c in (*BOX, *more)]


def held_by(outer: DataFrame, atoms: DataFrame) -> DataFrame:
    """``page_idx, ord, held``: how many elements each outer box holds, itself too if it is one; 0 comes out as no row."""
    a, b = [F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX]
    inside = (b[0] >= a[0] - HOLD) & (b[1] >= a[1] - HOLD) & (b[2] <= a[2] + HOLD) & (b[3] <= a[3] + HOLD)
    return box_join(outer.select("page_idx", "ord", *BOX), atoms.select("page_idx", "ord", *BOX), reach=HOLD, where=inside).groupBy("page_idx", F.col("a_ord").alias("ord")).agg(F.count(F.lit(1)).alias("held"))


def border_panels(atoms: DataFrame) -> DataFrame:
    """Each border with all it holds."""
    borders = atoms.where("kind = 'panel_border'")
    return _panel(borders.join(held_by(borders, atoms), ["page_idx", "ord"], "left").withColumns({"source": F.col("ord"), "members": F.coalesce("held", F.lit(1))}), "border")


def layout_panels(atoms: DataFrame) -> DataFrame:
    """Columns between two aligned bands with a background between: the next band below, the largest background."""
    bands, vectors = atoms.where("kind = 'color_band'").select("page_idx", "ord", *BOX), atoms.where("kind = 'vector_cluster'").select("page_idx", "ord", *BOX)
    close = lambda c, d: F.abs(c - d) <= ALIGNED
    below = (F.col("a_ord") != F.col("b_ord")) & (F.col("b_y0") > F.col("a_y0")) & close(F.col("b_x0"), F.col("a_x0")) & close(F.col("b_x1"), F.col("a_x1")) & close(width("b_"), width("a_"))
    pairs = box_join(bands, bands, reach=(ALIGNED, 0.0), axes="x", where=below)
    tops = pairs.groupBy("page_idx", F.col("a_ord").alias("ord"), *[F.col(f"a_{c}").alias(c) for c in BOX]).agg(F.min(F.struct("b_y0", "b_ord", "b_x0", "b_x1", "b_y1")).alias("n"))
    tops = tops.select("page_idx", "ord", *BOX, *[F.col(f"n.b_{c}").alias(f"n_{c}") for c in BOX])
    a, b = {c: F.col(f"a_{c}") for c in BOX}, {c: F.col(f"b_{c}") for c in BOX}
    behind = (b["x0"] >= a["x0"] - ALIGNED) & (b["x1"] <= a["x1"] + ALIGNED) & (b["y0"] >= a["y1"] - BEHIND) & (b["y1"] <= F.col("a_n_y1") + BEHIND)
    held = box_join(tops, vectors, reach=(ALIGNED, 0.0), axes="x", where=behind)
    best = held.groupBy("page_idx", F.col("a_ord").alias("ord")).agg(F.max_by(F.struct(*[F.col(f"a_{c}").alias(f"a_{c}") for c in BOX], *[F.col(f"a_n_{c}").alias(f"n_{c}") for c in BOX], *[F.col(f"b_{c}") for c in BOX]), F.struct(area("b_"), -F.col("b_ord"))).alias("r"))
    three = lambda c, f: f(F.col(f"r.a_{c}"), F.col(f"r.n_{c}"), F.col(f"r.b_{c}")).alias(c)
    boxes = best.select("page_idx", "ord", three("x0", F.least), three("y0", F.least), three("x1", F.greatest), three("y1", F.greatest))
    content = atoms.where(F.col("kind").isin("raster_image", "vector_cluster", "text_block", "color_band"))
    return _panel(boxes.join(held_by(boxes, content), ["page_idx", "ord"], "left").withColumns({"source": F.col("ord"), "members": F.coalesce("held", F.lit(0))}), "layout_column")


def promotable_images(atoms: DataFrame) -> DataFrame:
    """Images that may seed a panel: an xref image cut by the page only if it is the page's one image."""
    images = atoms.where("kind = 'raster_image'")
    alone = images.groupBy("page_idx").agg(F.count(F.lit(1)).alias("_n"))
    return images.join(alone, "page_idx").where((F.col("source") != "xref") | ~F.col("clipped") | (F.col("_n") == 1)).drop("_n")


def image_seed_panels(atoms: DataFrame, page_w: float, page_h: float) -> DataFrame:
    large = promotable_images(atoms).where(is_large_image("", page_w, page_h))
    return _panel(large.select("page_idx", F.col("ord").alias("source"), *BOX, F.lit(1).alias("members")), "image_seed")


def scope_numbers(images: DataFrame, atoms: DataFrame, page_h: float) -> DataFrame:
    """``page_idx, ord, number``: the figure number nearest below each image, of any text block that begins with one."""
    marks = atoms.where("kind = 'text_block'").withColumn("number", t.leading_figure_number(F.col("text"))).where("number IS NOT NULL")
    return nearest_caption(images.select("page_idx", "ord", *BOX), marks.select("page_idx", "ord", *BOX, "number"), page_h)


def image_cluster_panels(atoms: DataFrame, page_h: float) -> DataFrame:
    """Images in rows or columns, at most 40 points apart and not of different figures: their common box, if two or more."""
    images = promotable_images(atoms).select("page_idx", "ord", *BOX)
    numbered = stored(images.join(scope_numbers(images, atoms, page_h), ["page_idx", "ord"], "left"))
    apart = F.col("a_number") != F.col("b_number")
    links = self_pairs(numbered, reach=IMAGE_GAP, where=images_meet("a_", "b_") & ~F.coalesce(apart, F.lit(False)))
    joined = numbered.join(linked_groups(numbered, links), ["page_idx", "ord"])
    grouped = joined.groupBy("page_idx", F.col("cluster").alias("source")).agg(*[f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)], F.count(F.lit(1)).alias("members"))
    return _panel(grouped.where("members >= 2"), "image_cluster")


def roles_below(boxes: DataFrame, roles: DataFrame, gap: float = CAPTION_GAP) -> DataFrame:
    """``page_idx, ord, role, number, confidence``: scope roles that begin 0 to ``gap`` under a box and overlap it sideways."""
    scopes = roles.where("scope").select("page_idx", "ord", *BOX, "number", "confidence")
    near = (overlap_x("a_", "b_") > 0) & (F.col("b_y0") - F.col("a_y1")).between(0, gap)
    met = box_join(boxes.select("page_idx", "ord", *BOX), scopes, reach=(0.0, gap), where=near)
    return met.select("page_idx", F.col("a_ord").alias("ord"), F.col("b_ord").alias("role"), F.col("b_number").alias("number"), F.col("b_confidence").alias("confidence"))


def captioned_image_panels(atoms: DataFrame, roles: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Images that aren't large but have a caption below, by role, by text or by the nearest figure number: also ``captions`` (how many), ``numbers`` and ``confidence``."""
    images = stored(atoms.where("kind = 'raster_image'").where(~is_large_image("", page_w, page_h)).select("page_idx", "ord", *BOX))
    fold = lambda df: df.groupBy("page_idx", "ord").agg(F.count(F.lit(1)).alias("captions"), F.array_join(F.sort_array(F.collect_set("number")), ",").alias("numbers"), F.max("confidence").alias("confidence"))
    below = fold(roles_below(images, roles))
    number = scope_numbers(images, atoms, page_h).withColumnRenamed("number", "_scope")
    named = roles.where("scope AND number IS NOT NULL").groupBy("page_idx", F.col("number").alias("_scope")).agg(F.max_by("confidence", "ord").alias("_sure"))
    texts = atoms.where("kind = 'text_block'").where((F.length(stripped(F.col("text"))) >= 4) & t.starts_like_caption(F.col("text")))
    spoken = box_join(images, texts.select("page_idx", "ord", *BOX), reach=(0.0, CAPTION_GAP), where=(overlap_x("a_", "b_") > 0) & (F.col("b_y0") - F.col("a_y1")).between(0, CAPTION_GAP))
    spoken = spoken.select("page_idx", F.col("a_ord").alias("ord")).distinct().withColumn("_text", F.lit(True))
    all_ = images.join(below, ["page_idx", "ord"], "left").join(number, ["page_idx", "ord"], "left").join(named, ["page_idx", "_scope"], "left").join(spoken, ["page_idx", "ord"], "left")
    kept = all_.where("captions IS NOT NULL OR _scope IS NOT NULL OR _text")
    own, scoped = F.col("captions").isNotNull(), F.col("_sure").isNotNull()
    return kept.select(
        "page_idx", F.lit("captioned_image_seed").alias("panel_kind"), F.col("ord").alias("source"), *BOX, F.lit(1).cast("bigint").alias("members"),
        F.when(own, F.col("captions")).when(scoped, 1).otherwise(0).cast("bigint").alias("captions"),
        F.when(own, F.col("numbers")).otherwise(F.coalesce("_scope", F.lit(""))).alias("numbers"),
        F.when(own, F.col("confidence")).when(scoped, F.col("_sure")).when(F.col("_scope").isNotNull(), MARKER_SURE).alias("confidence"),
    )


def community_panels(atoms: DataFrame, existing: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """Visual communities: visuals at gaps of 60 points with no body text between, promoted to panels.

    Three members, or a hero among fewer; not with a page background, not spread thinly around one image, 3 % of the
    page at least; none that is an existing panel or hangs over the page.
    """
    visual = stored(atoms.where(is_visual(F.col("kind"), F.col("text"), "", page_w, page_h)).select("page_idx", "ord", "kind", *BOX, "source", "clipped"))
    body = atoms.where(is_body_text(F.col("kind"), F.col("text"), "", page_w))
    member = visual.join(page_clusters(visual, COMMUNITY_GAP, body, COMMUNITY_BARRIER), ["page_idx", "ord"])
    images = atoms.where("kind = 'raster_image'").groupBy("page_idx").agg(F.count(F.lit(1)).alias("_images"))
    k = F.col("kind")
    hero, raster = is_hero(k, "", page_w, page_h), k == "raster_image"
    per = member.groupBy("page_idx", F.col("cluster").alias("source")).agg(
        *[f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)],
        F.count(F.lit(1)).alias("members"), F.bool_or(k != "color_band").alias("_primary"), F.bool_or(hero).alias("_hero"), F.bool_or((k == "color_band") & hero).alias("_hero_band"),
        F.bool_or((k == "vector_cluster") & is_background("", page_w, page_h)).alias("_background"), F.count_if(raster).alias("_rasters"), F.max(F.when(raster, area(""))).alias("_raster_area"),
        F.bool_or(raster & (F.col("source") == "xref") & F.col("clipped")).alias("_cut"),
    ).join(images, "page_idx", "left")
    small = F.col("_hero") & ~((F.col("members") == 1) & F.col("_cut") & (F.coalesce("_images", F.lit(0)) > 1))
    thin = (F.col("_rasters") == 1) & (F.col("_raster_area") > 0) & (area("") / F.col("_raster_area") >= SPREAD_RATIO) & (F.col("_raster_area") / area("") <= SPREAD_SHARE)
    good = (F.col("_primary") | F.col("_hero_band")) & ~F.col("_background") & ((F.col("members") >= COMMUNITY_MEMBERS) | small) & ~F.coalesce(thin, F.lit(False)) & (area("") / max(page_w * page_h, 1.0) >= COMMUNITY_AREA)
    promoted = per.where(good & ~hangs_over("", page_w, page_h)).select("page_idx", "source", *BOX, "members")
    new = box_join(promoted, existing.select("page_idx", *BOX), where=iou("a_", "b_") > SAME_PANEL, how="left_anti")
    return _panel(new, "visual_community")


def caption_anchor_panels(atoms: DataFrame, roles: DataFrame, existing: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """What stands above each caption: visuals within reach and in line, unless an existing panel or that of an earlier caption says the same. ``source`` is the caption.

    ``existing`` has ``multi``: panels that span several captions don't count.
    """
    captions = roles.where(F.col("scope") & (F.col("role") == "figure_caption")).select("page_idx", "ord", *BOX)
    visuals = atoms.where(F.col("kind").isin("raster_image", "vector_cluster", "color_band", "panel_border")).where(~spans_page("", page_w, page_h)).select("page_idx", "ord", *BOX)
    gap = F.col("a_y0") - F.col("b_y1")
    reach = max(ANCHOR_GAP, page_h * ANCHOR_GAP_SHARE)
    in_line = overlap_x("a_", "b_") / F.greatest(F.lit(1.0), F.least(width("a_"), width("b_"))) >= ANCHOR_OVERLAP
    met = box_join(captions, visuals, reach=(0.0, reach), where=gap.between(0, reach) & (F.col("a_y0") - F.col("b_y0") <= page_h * ANCHOR_HEIGHT) & in_line)
    anchored = met.groupBy("page_idx", F.col("a_ord").alias("ord")).agg(*[f(f"b_{c}").alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)], F.count(F.lit(1)).alias("members"))
    anchored = stored(anchored.where(area("") / max(page_w * page_h, 1.0) >= ANCHOR_AREA))
    same = (iou("a_", "b_") > SAME_PANEL) | ((cover_of_smaller("a_", "b_") > ANCHOR_COVER) & (area("b_") / F.greatest(area("a_"), F.lit(1.0)) >= ANCHOR_RATIO))
    new = stored(box_join(anchored, existing.where("NOT multi").select("page_idx", *BOX), where=same, how="left_anti"))
    rivals = box_join(new, new, where=(F.col("b_ord") < F.col("a_ord")) & same)
    gone = losers(rivals.select("page_idx", F.col("b_ord").alias("better"), F.col("a_ord").alias("worse")))
    return _panel(new.join(gone, ["page_idx", "ord"], "left_anti").withColumnRenamed("ord", "source"), "caption_anchor_visual")


def caption_scopes(panels: DataFrame, roles: DataFrame) -> DataFrame:
    """``page_idx, id, captions, numbers, multi, confidence`` of panels (``page_idx, id``, a box) with scope roles below (up to 48 points) or inside.

    ``multi`` is a panel of several figure numbers, or of several captions without a number; a confidence is known of
    one caption only.
    """
    p = panels.select("page_idx", F.col("id").alias("ord"), *BOX)
    scopes = roles.where("scope").select("page_idx", "ord", *BOX, "number", "confidence")
    inside = (F.col("b_y0") >= F.col("a_y0") - HOLD) & (F.col("b_y1") <= F.col("a_y1") + HOLD) & (overlap_x("a_", "b_") / F.greatest(F.lit(1.0), width("b_")) >= CAPTION_INSIDE)
    held = box_join(p, scopes, reach=HOLD, where=inside).select("page_idx", F.col("a_ord").alias("ord"), F.col("b_ord").alias("role"), F.col("b_number").alias("number"), F.col("b_confidence").alias("confidence"))
    every = roles_below(p, roles, SCOPE_GAP).unionByName(held).distinct()
    out = every.groupBy("page_idx", F.col("ord").alias("id")).agg(F.count(F.lit(1)).alias("captions"), F.array_join(F.sort_array(F.collect_set("number")), ",").alias("numbers"), F.countDistinct("number").alias("_n"), F.max("confidence").alias("_c"))
    multi = (F.col("_n") > 1) | ((F.col("_n") == 0) & (F.col("captions") > 1))
    return out.select("page_idx", "id", "captions", "numbers", multi.alias("multi"), F.when(F.col("captions") == 1, F.col("_c")).alias("confidence"))


def scope_texts(roles: DataFrame, atoms: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """``page_idx, caption, ord, score``: text blocks over a caption that may annotate its figure, with a positive score."""
    captions = roles.where(F.col("scope") & (F.col("role") == "figure_caption")).select("page_idx", "ord", *BOX)
    texts = atoms.where("kind = 'text_block'").where(stripped(F.col("text")) != "").select("page_idx", "ord", *BOX, "text").join(captions.select("page_idx", "ord"), ["page_idx", "ord"], "left_anti")
    window = max(72.0, min(page_h * 0.18, CAPTION_GAP * 3.0))
    margin = F.greatest(F.lit(24.0), F.least(F.lit(page_w * 0.08), F.greatest(width("a_"), F.lit(1.0)) * 0.28))
    centre = (F.col("b_x0") + F.col("b_x1")) / 2
    band = centre.between(F.col("a_x0") - margin, F.col("a_x1") + margin)
    along = zero(overlap_x("a_", "b_")) / F.least(F.greatest(width("a_"), F.lit(1.0)), F.greatest(width("b_"), F.lit(1.0)))
    near = (F.col("b_y1") <= F.col("a_y0") + 2.0) & (F.col("b_y0") >= F.col("a_y0") - window) & (band | (along > 0))
    met = box_join(captions, texts, axes="y", reach=(0.0, window), where=near)
    score = t.scope_text_score(F.col("b_text"), F.greatest(height("b_"), F.lit(1.0)), zero(F.col("a_y0") - F.col("b_y1")), page_h) + F.when(band, 0.18).otherwise(F.lit(0.0)) + F.least(F.lit(0.35), along * 0.3)
    return met.select("page_idx", F.col("a_ord").alias("caption"), F.col("b_ord").alias("ord"), score.alias("score")).where("score > 0")


def propose_panels(atoms: DataFrame, page_w: float, page_h: float) -> DataFrame:
    """All panels of all kinds with their caption scopes: ``page_idx, id`` (1, 2, ... by kind, then source), the panel's columns, ``captions, numbers, multi, confidence``."""
    roles = stored(text_roles(atoms, page_w, page_h))
    plain = ("page_idx", "panel_kind", "source", *BOX, "members")
    first = [border_panels(atoms), layout_panels(atoms), image_seed_panels(atoms, page_w, page_h), image_cluster_panels(atoms, page_h), captioned_image_panels(atoms, roles, page_w, page_h).select(*plain)]
    known = stored(reduce(DataFrame.unionByName, first))
    known = stored(known.unionByName(community_panels(atoms, known, page_w, page_h)))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(PANEL_KINDS) for x in (k, i)])[F.col("panel_kind")]
    numbered = lambda df: df.withColumn("id", order.cast("bigint") * (1 << 32) + F.col("source"))
    scoped = caption_scopes(numbered(known), roles)
    multi = numbered(known).join(scoped.select("page_idx", "id", "multi"), ["page_idx", "id"], "left").withColumn("multi", F.coalesce("multi", F.lit(False)))
    every = stored(numbered(known.unionByName(caption_anchor_panels(atoms, roles, multi, page_w, page_h))))
    return every.join(caption_scopes(every, roles), ["page_idx", "id"], "left").na.fill({"captions": 0, "numbers": "", "multi": False})


PANEL_KINDS = ("border", "layout_column", "image_seed", "image_cluster", "captioned_image_seed", "visual_community", "caption_anchor_visual")
