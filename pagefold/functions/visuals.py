"""What an element of a page is by its kind, place and size: body text, boilerplate, background, hero, large image.

Arguments are columns; ``box`` is a prefix or a tuple as in ``geometry``. Sizes of the page are numbers. An element with
a null side is nothing of this (null counts as false in a filter).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefold.functions.geometry import Box, area, edges_touched, gap, height, inter_area, overlap_x, overlap_y, sides, width, zero

# Shares of the page, sizes in points and counts that the rules compare with.
BODY_WIDTH, BODY_LINES, BODY_CHARS = 0.4, 2, 20
BAND_EDGE, HEADER, FOOTER, SMALL_AREA = 12.0, 0.08, 0.95, 0.01
VISIBLE, OVERHANG_LEAST, OVERHANG = 0.85, 12.0, 0.025
BACKGROUND_AREA, EDGE, BACKGROUND_EDGES = 0.75, 12.0, 3
HERO_AREA, HERO_WIDTH, HERO_HEIGHT, HERO_LESSER = 0.25, 0.45, 0.18, 0.12
LARGE_SIDE, LARGE_AREA = 180.0, 50_000.0
LARGE_WIDTH, LARGE_HEIGHT, LARGE_SHARE = 0.45, 0.15, 0.08
IMAGE_GAP = 40.0
SEED_EDGE, SEED_AREA, SEED_WIDTH, SEED_HEIGHT = 0.12, 0.01, 0.2, 0.08
VISUAL_KINDS = ("vector_cluster", "raster_image", "color_band", "panel_border")
NESTED_COVER, NESTED_RATIO = 0.86, 1.18
SUBORDINATE_AREA, SUBORDINATE_TOUCH, SUBORDINATE_GAP, SUBORDINATE_ALIGNED = 0.16, 4.0, 0.12, 0.45


def _page_area(w: float, h: float) -> float:
    return max(w * h, 1.0)


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_body_text(kind: Column, text: Column, box: Box, page_w: float) -> Column:
    """A text block of two or more lines over 40 % of the page's width."""
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return (kind == "text_block") & (zero(width(box)) / max(page_w, 1.0) >= BODY_WIDTH) & (lines >= BODY_LINES) & (F.length(stripped(text)) >= BODY_CHARS)


def is_edge_boilerplate(kind: Column, box: Box, page_w: float, page_h: float) -> Column:
    """A small image in the head or foot of the page, or a small band at its very edge."""
    _, y0, _, y1 = sides(box)
    at_edge = F.when(kind == "color_band", (y0 <= BAND_EDGE) | (y1 >= page_h - BAND_EDGE)).when(kind == "raster_image", (y0 <= page_h * HEADER) | (y1 >= page_h * FOOTER)).otherwise(F.lit(False))
    return at_edge & (area(box) / _page_area(page_w, page_h) <= SMALL_AREA)


def _visible(box: Box, page_w: float, page_h: float) -> Box:
    inside = lambda c, m: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(m)))
    x0, y0, x1, y1 = sides(box)
    return inside(x0, page_w), inside(y0, page_h), inside(x1, page_w), inside(y1, page_h)


def is_offpage(kind: Column, box: Box, page_w: float, page_h: float) -> Column:
    """Drawings and bands that lie outside the page by 15 % of their area or far over an edge, or have no area."""
    x0, y0, x1, y1 = sides(box)
    hidden = area(_visible(box, page_w, page_h)) / area(box) < VISIBLE
    over_x, over_y = F.greatest(F.lit(0.0), -x0, x1 - page_w), F.greatest(F.lit(0.0), -y0, y1 - page_h)
    over = (over_x > max(OVERHANG_LEAST, page_w * OVERHANG)) | (over_y > max(OVERHANG_LEAST, page_h * OVERHANG))
    return kind.isin("vector_cluster", "color_band", "panel_border") & F.when(area(box) <= 0, F.lit(True)).otherwise(hidden | over)


def is_background(box: Box, page_w: float, page_h: float, if_hidden: bool = False) -> Column:
    """What covers three quarters of the page or touches three of its edges; ``if_hidden`` is said of what isn't on the page."""
    seen = _visible(box, page_w, page_h)
    large = (area(seen) / _page_area(page_w, page_h) >= BACKGROUND_AREA) | (edges_touched(seen, page_w, page_h, EDGE) >= BACKGROUND_EDGES)
    return F.when(area(seen) <= 0, F.lit(if_hidden)).otherwise(large)


def is_visual(kind: Column, text: Column, box: Box, page_w: float, page_h: float) -> Column:
    """An element that visual communities are made of."""
    out = is_edge_boilerplate(kind, box, page_w, page_h) | is_offpage(kind, box, page_w, page_h) | ((kind == "vector_cluster") & is_background(box, page_w, page_h))
    return kind.isin(*VISUAL_KINDS) & ~F.coalesce(is_body_text(kind, text, box, page_w), F.lit(False)) & ~out


def is_hero(kind: Column, box: Box, page_w: float, page_h: float) -> Column:
    """A visual that is large by itself: a quarter of the page, or wide and high enough."""
    seen = _visible(box, page_w, page_h)
    share = area(seen) / _page_area(page_w, page_h)
    wide = (width(seen) / max(page_w, 1.0) >= HERO_WIDTH) & (height(seen) / max(page_h, 1.0) >= HERO_HEIGHT) & (share >= HERO_LESSER)
    return kind.isin("vector_cluster", "raster_image", "color_band") & ~is_background(box, page_w, page_h) & (area(seen) > 0) & ((share >= HERO_AREA) | wide)


def is_large_image(box: Box, page_w: float, page_h: float) -> Column:
    """Large in points or for its page."""
    w, h = zero(width(box)), zero(height(box))
    points = (w >= LARGE_SIDE) & (h >= LARGE_SIDE) & (w * h >= LARGE_AREA)
    shares = (w / max(page_w, 1.0) >= LARGE_WIDTH) & (h / max(page_h, 1.0) >= LARGE_HEIGHT) & (w * h / _page_area(page_w, page_h) >= LARGE_SHARE)
    return points | shares


def spans_page(box: Box, page_w: float, page_h: float) -> Column:
    """Three quarters of the page visible, or three edges touched by the whole box."""
    return (area(_visible(box, page_w, page_h)) / _page_area(page_w, page_h) >= BACKGROUND_AREA) | (edges_touched(box, page_w, page_h, EDGE) >= BACKGROUND_EDGES)


def hangs_over(box: Box, page_w: float, page_h: float) -> Column:
    """Farther over an edge of the page than a bleed."""
    x0, y0, x1, y1 = sides(box)
    tx, ty = max(OVERHANG_LEAST, page_w * OVERHANG), max(OVERHANG_LEAST, page_h * OVERHANG)
    return (x0 < -tx) | (x1 > page_w + tx) | (y0 < -ty) | (y1 > page_h + ty)


def is_edge_tiny(box: Box, page_w: float, page_h: float) -> Column:
    """At most a hundredth of the page, in its head or foot."""
    _, y0, _, y1 = sides(box)
    return (area(box) / _page_area(page_w, page_h) <= SMALL_AREA) & ((y0 <= page_h * HEADER) | (y1 >= page_h * FOOTER))


def is_boilerplate_seed(kinds: Column, members: Column, evidence: Column, box: Box, page_w: float, page_h: float) -> Column:
    """A lone raster seed, tiny and in the head or foot, that nothing but its image speaks for.

    ``kinds`` are the kinds of the source elements, ``members`` their number, ``evidence`` the tags.
    """
    _, y0, _, y1 = sides(box)
    share = area(box) / _page_area(page_w, page_h)
    at_edge = (y0 <= page_h * SEED_EDGE) | (y1 >= page_h * (1 - SEED_EDGE))
    tiny = (share <= SEED_AREA) | ((zero(width(box)) / max(page_w, 1.0) <= SEED_WIDTH) & (zero(height(box)) / max(page_h, 1.0) <= SEED_HEIGHT))
    weak = (members <= 1) & (F.size(F.array_except(evidence, F.array(F.lit("captioned_image_seed"), F.lit("image_seed")))) == 0)
    rich = (members >= 3) | F.arrays_overlap(evidence, F.array(F.lit("image_cluster"), F.lit("layout_column"), F.lit("border"))) | F.array_contains(kinds, "vector_cluster")
    lone = (F.size(kinds) > 0) & (F.size(F.array_remove(kinds, "raster_image")) == 0)
    return at_edge & tiny & weak & lone & ~rich


def images_meet(a: Box, b: Box, most: float = IMAGE_GAP) -> Column:
    """Images side by side in a row or stacked in a column, at most ``most`` apart."""
    return ((overlap_y(a, b) > 0) & (-overlap_x(a, b) <= most)) | ((overlap_x(a, b) > 0) & (-overlap_y(a, b) <= most))


def is_nested_peer(a: Box, b: Box) -> Column:
    """One of both lies in the other and is clearly smaller."""
    least, most = F.greatest(F.least(area(a), area(b)), F.lit(1.0)), F.greatest(area(a), area(b))
    return (inter_area(a, b) > 0) & (inter_area(a, b) / least >= NESTED_COVER) & (most / least >= NESTED_RATIO)


def is_subordinate_peer(a: Box, b: Box) -> Column:
    """``b`` is a small part that sits at ``a``."""
    along = lambda o, s: zero(o(a, b)) / F.greatest(F.least(s(a), s(b)), F.lit(1.0))
    aw, ah = lambda x: F.greatest(width(x), F.lit(0.0)), lambda x: F.greatest(height(x), F.lit(0.0))
    touch = F.greatest(F.lit(SUBORDINATE_TOUCH), F.least(aw(a), ah(a)) * SUBORDINATE_GAP)
    aligned = F.greatest(along(overlap_x, aw), along(overlap_y, ah)) >= SUBORDINATE_ALIGNED
    return (area(a) > 0) & (area(b) > 0) & (area(b) < area(a) * SUBORDINATE_AREA) & (gap(a, b) <= touch) & aligned


