"""Scores of proposed boundaries and of the evidence behind them, as column expressions.

A box is a prefix or a tuple as in ``geometry``; ``a`` is the box to compare with (selected, complete, base), ``b`` the
proposed one. Confidences lie in 0 to 1; an object's score counts up to 10. A null part makes a score null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefold.functions.geometry import Box, area, cover_of_smaller, height, inter_area, overlap_x, overlap_y, saturation, sides, soft_count, width, zero

# Weights and limits of the scores, by score.
CURRENT = {"base": 1.0, "confidence": 0.75, "strength": 0.25, "complete": 0.25, "extent": 0.2}
COMPLETE_STRATEGIES = ("complete_object_evidence", "compact_object_evidence", "primitive_evidence_refined_complete", "content_evidence_refined_complete")
EXTENT_STRATEGIES = ("nonraster_annotation_extent", "raster_annotation_extent")
CALIBRATED = {"base": 0.85, "proposal": 0.8, "confidence": 0.35, "strength": 0.2, "compact": 1.35, "retained": 0.35, "contained": 0.25, "side": 1.4, "outside": 1.8, "growth": 2.5, "lost": 2.2, "component": 8.0, "content": 18.0}
RETAINED, COMPONENT_RETAINED, CONTENT_RETAINED = 0.7, 0.82, 0.94
STRATEGY_SCORES = {"visual_atom_union": 0.25, "single_raster_core": 0.25, "primitive_evidence_union": 0.25, "support_bbox": 0.05}
OTHER_STRATEGY = 0.1
TRIM = {"most": 0.92, "factor": 1.9, "span": 0.75, "extent": 0.24, "fade": 0.12}
TRIMMED = {"base": -0.22, "confidence": 0.16, "strength": 0.06, "compact": 0.55, "axis": 0.85, "retained": 0.08, "both": 0.25, "dominance": 1.35, "weak": 4.8, "weak_below": 0.48}
BASE_BOUNDARY = {"base": 1.0, "confidence": 0.55, "strength": 0.25, "complete": 0.2}
EXTENT = {"base": 2.05, "count": 0.25, "sides": 1.9, "compact": 0.45, "growth": 0.75, "annotations": 0.55, "side": 0.5}
EXTENT_AREA, EXTENT_SIDE = 1.65, 1.75
COMPLETE = {"base": 1.0, "confidence": 0.8, "strength": 0.5}
CONTENT = {"strength": 1.4, "compact": 0.4, "overlap": 0.2, "apart": 1.5}
AUTHORITY = {"excluded": 1.8, "support_only": 1.4, "region": 0.2, "dense": 0.15, "promoted": 0.35, "promotion": 2.5, "sparse": 0.18, "branch": 0.6, "primitive": 0.3, "whole": 0.25}
RICHNESS = (("primitives", 0.35, 4.0), ("kinds", 0.25, 2.0), ("groups", 0.2, 2.0), ("backgrounds", 0.15, 2.0))
CONTEXT = {"strength": 0.025, "most": 6.0, "overlap": 0.25, "gain": 0.22, "scope": 0.12, "area": 1.85, "excess": 0.22}
GROUP = {"base": 0.55, "alone": 0.65, "retained": 0.8, "contained": 0.2, "compact": 0.4, "confidence": 0.5, "strength": 0.8, "extends": 0.15}
OWNER_GAP = 8.0
LOCAL = {"semantic": 0.8, "overlap": 0.6, "close": 0.4, "centre": 0.25, "area": 0.1, "outside": 0.35, "off_centre": 0.45, "aligned": 0.32, "span": 3.0, "gap": 0.55}
TOUCH_LEAST, TOUCH, SUPPORT_FLOOR = 4.0, 0.08, 0.2
FRAGMENT = {"ratio": 0.58, "loss": 0.42, "narrow": 0.62, "long": 0.72}
LOCAL_REPLACES = {"ratio": 0.12, "confidence": 0.9, "cover": 0.8}


def _one(c: Column) -> Column:
    return F.greatest(c, F.lit(1.0))


def strength(score: Column) -> Column:
    """An object's score as a share of 10."""
    return F.least(zero(score), F.lit(10.0)) / 10.0


def retained(a: Box, b: Box) -> Column:
    """How much of ``a`` lies in ``b``; an area below 1 counts as 1."""
    return inter_area(a, b) / _one(area(a))


def _inward(a: Box, b: Box) -> dict[str, Column]:
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = sides(a), sides(b)
    w, h = _one(width(a)), _one(height(a))
    return {"left": (bx0 - ax0) / w, "top": (by0 - ay0) / h, "right": (ax1 - bx1) / w, "bottom": (ay1 - by1) / h}


def trims(a: Box, b: Box) -> dict[str, Column]:
    """What ``b`` leaves out of ``a`` at each side, over the size of ``a``."""
    return {s: zero(d) for s, d in _inward(a, b).items()}


def side_loss(a: Box, b: Box) -> Column:
    """The trims of all four sides together."""
    t = trims(a, b)
    return t["left"] + t["top"] + t["right"] + t["bottom"]


def external_expansion(a: Box, b: Box) -> Column:
    """How far ``b`` reaches over ``a``, all four sides together, over the size of ``a``."""
    t = {s: zero(-d) for s, d in _inward(a, b).items()}
    return t["left"] + t["top"] + t["right"] + t["bottom"]


def expanded_sides(a: Box, b: Box, tolerance: float = 0.0) -> Column:
    """Sides at which ``b`` reaches over ``a``."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = sides(a), sides(b)
    over = [(ax0 - bx0) > tolerance, (ay0 - by0) > tolerance, (bx1 - ax1) > tolerance, (by1 - ay1) > tolerance]
    total = F.lit(0)
    for o in over:
        total = total + o.cast("int")
    return total


def multi_side_support(a: Box, b: Box) -> Column:
    n = expanded_sides(a, b).cast("double")
    return zero(n - 1) / (n + 2)


def within_budget(a: Box, b: Box) -> Column:
    """An extended box that is not much larger than the base: area, width and height."""
    return (area(a) > 0) & (area(b) > 0) & (area(b) / area(a) <= EXTENT_AREA) & (_one(width(b)) / _one(width(a)) <= EXTENT_SIDE) & (_one(height(b)) / _one(height(a)) <= EXTENT_SIDE)


def axis_trim_weight(start: Column, end: Column, new_start: Column, new_end: Column, span_ratio: Column) -> Column:
    """How far an axis may move to a tighter range: trims that are balanced, not too long, and seen over the axis."""
    length = _one(end - start)
    first, last = zero(new_start - start) / length, zero(end - new_end) / length
    total, larger = first + last, F.greatest(first, last)
    balance = F.when(larger > 0, F.least(first, last) / larger).otherwise(F.lit(0.0))
    span = F.when(span_ratio > 0, F.least(F.lit(1.0), span_ratio / TRIM["span"])).otherwise(F.lit(1.0))
    extent = zero(F.least(F.lit(1.0), 1 - zero(total - TRIM["extent"]) / TRIM["fade"]))
    return F.least(F.lit(TRIM["most"]), F.sqrt(zero(total)) * balance * span * extent * TRIM["factor"])


def current_boundary_score(confidence: Column, object_score: Column, strategy: Column) -> Column:
    """The score of the boundary in force; arguments are the greatest of its candidates."""
    w = CURRENT
    bonus = F.when(strategy.isin(*COMPLETE_STRATEGIES), w["complete"]).when(strategy.isin(*EXTENT_STRATEGIES), w["extent"]).otherwise(F.lit(0.0))
    return w["base"] + confidence * w["confidence"] + strength(object_score) * w["strength"] + bonus


def strategy_score(strategy: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STRATEGY_SCORES.items() for x in kv])
    return F.coalesce(table[strategy], F.lit(OTHER_STRATEGY))


def calibrated_boundary_score(a: Box, b: Box, confidence: Column, object_score: Column, proposal_score: Column, strategy: Column, component: Column, content: Column) -> Column:
    """The score of a calibrated proposal ``b`` against the selected box ``a``; ``component`` and ``content`` are the shares of active evidence that it keeps."""
    w, aa, ba = CALIBRATED, _one(area(a)), _one(area(b))
    kept = inter_area(a, b) / aa
    gains = w["base"] + F.least(zero(proposal_score), F.lit(1.0)) * w["proposal"] + confidence * w["confidence"] + strength(object_score) * w["strength"] + strategy_score(strategy)
    shape = zero(1 - ba / aa) * w["compact"] + kept * w["retained"] + inter_area(a, b) / ba * w["contained"]
    costs = side_loss(a, b) * w["side"] + external_expansion(a, b) * w["outside"] + zero(ba / aa - 1) * w["growth"]
    losses = zero(RETAINED - kept) * w["lost"] + zero(COMPONENT_RETAINED - component) * w["component"] + zero(CONTENT_RETAINED - content) * w["content"]
    return gains + shape - costs - losses


def axis_trimmed(a: Box, b: Box, span_w: Column, span_h: Column) -> dict[str, Column]:
    """The selected box moved on each axis towards ``b`` by that axis's weight: ``x0, y0, x1, y1, x_weight, y_weight``."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = sides(a), sides(b)
    x, y = axis_trim_weight(ax0, ax1, bx0, bx1, span_w), axis_trim_weight(ay0, ay1, by0, by1, span_h)
    return {"x0": ax0 + zero(bx0 - ax0) * x, "y0": ay0 + zero(by0 - ay0) * y, "x1": ax1 - zero(ax1 - bx1) * x, "y1": ay1 - zero(ay1 - by1) * y, "x_weight": x, "y_weight": y}


def axis_trimmed_score(a: Box, trimmed: Box, x_weight: Column, y_weight: Column, confidence: Column, object_score: Column, current: Column) -> Column:
    """The score of an axis-trimmed box; a trim mostly sideways or weak on both axes costs."""
    w, aa = TRIMMED, _one(area(a))
    best = F.greatest(x_weight, y_weight)
    gains = current + w["base"] + confidence * w["confidence"] + strength(object_score) * w["strength"] + zero(1 - _one(area(trimmed)) / aa) * w["compact"]
    axis = (best + (x_weight + y_weight) * w["both"]) * w["axis"] + inter_area(a, trimmed) / aa * w["retained"]
    return gains + axis - zero(x_weight - y_weight) * w["dominance"] - zero(w["weak_below"] - best) * w["weak"]


def base_boundary_score(confidence: Column, object_score: Column, strategy: Column) -> Column:
    w = BASE_BOUNDARY
    return w["base"] + confidence * w["confidence"] + strength(object_score) * w["strength"] + F.when(strategy.isin(*COMPLETE_STRATEGIES), confidence * w["complete"]).otherwise(F.lit(0.0))


def annotation_extent_score(a: Box, b: Box, source: Column, count: Column, annotation_area: Column, penalty: Column) -> Column:
    """The score of a base box extended to its annotations: ``count`` and summed area of these, ``source`` the support of where they come from."""
    w, aa, ba = EXTENT, _one(area(a)), _one(area(b))
    gains = w["base"] + source + w["count"] * soft_count(count, 3.0) + w["sides"] * multi_side_support(a, b) + w["compact"] * (aa / ba)
    return gains - w["growth"] * zero(ba / aa - 1) - w["annotations"] * (annotation_area / aa) - w["side"] * external_expansion(a, b) - penalty


def complete_boundary_score(confidence: Column, object_score: Column) -> Column:
    w = COMPLETE
    return w["base"] + confidence * w["confidence"] + strength(object_score) * w["strength"]


def evidence_richness(**counts: Column) -> Column:
    """Saturated counts of ``primitives``, ``kinds``, ``groups`` and ``backgrounds``."""
    total = F.lit(0.0)
    for name, weight, pivot in RICHNESS:
        total = total + soft_count(counts[name].cast("double"), pivot) * weight
    return total


def content_authority(excluded: Column, support_only: Column, source: Column, active_ratio: Column, promotion: Column, strategy: Column, primitive_only: Column, ratio: Column, richness: Column) -> Column:
    """How far a content branch may speak for a whole figure. ``active_ratio`` is null where it was not measured."""
    w = AUTHORITY
    on = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    dense = saturation(F.coalesce(active_ratio, F.lit(0.0)), 0.35, 0.6)
    pixel = dense * (w["dense"] + F.least(F.lit(w["promoted"]), zero(-promotion) * w["promotion"])) - F.when(active_ratio.isNotNull(), (1 - dense) * w["sparse"]).otherwise(F.lit(0.0))
    from_pixels = F.when(source.isin("raster_pixel_content", "raster_background_difference"), pixel).otherwise(F.lit(0.0))
    base = on(excluded, w["excluded"]) + on(support_only, w["support_only"]) + on(source.isin("raster_split_proposal", "primitive_evidence_region"), w["region"]) + from_pixels
    return base + on(strategy == "raster_content_branch", w["branch"]) + on(primitive_only, w["primitive"]) + on(ratio >= 0.9, w["whole"]) + richness


def content_replacement_score(a: Box, b: Box, confidence: Column, object_score: Column, authority: Column) -> Column:
    """The score of a content box ``b`` in place of the complete box ``a``; penalties shrink with authority."""
    w, ratio, over = CONTENT, _one(area(b)) / _one(area(a)), cover_of_smaller(b, a)
    gains = confidence + strength(object_score) * w["strength"] + authority + zero(1 - ratio) * w["compact"] + over * w["overlap"]
    sides_cost = side_loss(a, b) * F.greatest(F.lit(0.8), 3.3 - authority) + external_expansion(a, b) * F.greatest(F.lit(0.45), 2.2 - authority * 0.45)
    return gains - sides_cost - zero(ratio - 1) * F.greatest(F.lit(0.1), 0.7 - authority * 0.15) - zero(1 - over) * w["apart"]


def is_fragmentary(a: Box, b: Box) -> Column:
    """A content box that keeps the length of one axis and little of the other."""
    w = FRAGMENT
    wide, high = width(b) / _one(width(a)), height(b) / _one(height(a))
    one_way = ((wide < w["narrow"]) & (high >= w["long"])) | ((high < w["narrow"]) & (wide >= w["long"]))
    return (area(a) > 0) & (area(b) > 0) & (area(b) / area(a) < w["ratio"]) & (side_loss(a, b) >= w["loss"]) & one_way


def content_can_replace(a: Box, b: Box, score: Column, complete: Column, coarse: Column) -> Column:
    """A content box beats the complete one unless it is a fragment from a coarse decomposition of a scoped figure (``coarse``)."""
    return (area(a) > 0) & (area(b) > 0) & ~(coarse & is_fragmentary(a, b)) & (score > complete)


def local_can_replace(a: Box, b: Box, confidence: Column, primitive_boundary: Column) -> Column:
    """Local evidence ``b`` with a selected primitive boundary may stand for the complete box ``a``."""
    w = LOCAL_REPLACES
    return (area(a) > 0) & (area(b) > 0) & (area(b) / area(a) >= w["ratio"]) & (confidence >= w["confidence"]) & primitive_boundary & (cover_of_smaller(b, a) >= w["cover"])


def contextual_visual_score(a: Box, b: Box, confidence: Column, object_score: Column, gain: Column, scoped: Column) -> Column:
    """The score of a broader visual context ``b`` around the selected box ``a``; ``gain`` counts the visuals it adds."""
    w = CONTEXT
    parts = confidence + F.least(object_score, F.lit(w["most"])) * w["strength"] + F.least(F.lit(1.0), retained(a, b)) * w["overlap"] + soft_count(gain.cast("double"), 2.0) * w["gain"]
    return parts + F.when(scoped, w["scope"]).otherwise(F.lit(0.0)) - zero(_one(area(b)) / _one(area(a)) - w["area"]) * w["excess"]


def raster_group_score(group: Box, b: Box, confidence: Column | None = None, object_score: Column | None = None, extends: Column | None = None) -> Column:
    """The score of box ``b`` for a group of rasters; without a candidate (no confidence) only its place counts."""
    w = GROUP
    place = retained(group, b) * w["retained"] + cover_of_smaller(b, group) * w["contained"]
    if confidence is None:
        return w["alone"] + place
    return w["base"] + place + zero(1 - _one(area(b)) / _one(area(group))) * w["compact"] + confidence * w["confidence"] + strength(object_score) * w["strength"] + F.when(extends, w["extends"]).otherwise(F.lit(0.0))


def same_row_affinity(a: Box, b: Box) -> Column:
    """How much two boxes look like one row: aligned, of one height, near."""
    (ax0, _, ax1, _), (bx0, _, bx1, _) = sides(a), sides(b)
    apart = zero(F.when(ax0 <= bx0, bx0 - ax1).otherwise(ax0 - bx1))
    low, high = F.least(_one(height(a)), _one(height(b))), F.greatest(_one(height(a)), _one(height(b)))
    return zero(zero(overlap_y(a, b)) / low * (low / high) - apart / F.least(_one(width(a)), _one(width(b))))


def owner_affinity(content: Box, note: Box) -> Column:
    """How near an annotation is to a content box, more so where it runs along it."""
    dx, dy = zero(-overlap_x(content, note)), zero(-overlap_y(content, note))
    close = 1 / (1 + F.sqrt(dx * dx + dy * dy) / OWNER_GAP)
    along = lambda o, s: zero(o(content, note)) / F.least(_one(s(content)), _one(s(note)))
    return close + F.greatest(along(overlap_x, width), along(overlap_y, height)) * close


def local_support(base: Box, note: Box, semantic: Column) -> Column:
    """How well an annotation belongs to a base box by its place; 0 where its text says nothing (``semantic`` 0)."""
    w = LOCAL
    (bx0, by0, bx1, by1), (nx0, ny0, nx1, ny1) = sides(base), sides(note)
    note_area, bw, bh = _one(area(note)), _one(width(base)), _one(height(base))
    share = inter_area(base, note) / note_area
    in_x, in_y = ((nx0 + nx1) / 2.0).between(bx0, bx1), ((ny0 + ny1) / 2.0).between(by0, by1)
    num = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    inside, aligned = num(in_x & in_y), num(in_x | in_y)
    dx, dy = zero(-overlap_x(base, note)), zero(-overlap_y(base, note))
    close = 1 / (1 + F.sqrt(dx * dx + dy * dy) / _one(F.least(width(base), height(base))))
    wide, high = F.least(F.lit(2.0), width(note) / bw), F.least(F.lit(2.0), height(note) / bh)
    outside = (1 - F.least(F.lit(1.0), share)) * (wide + high) * (w["outside"] + (1 - inside) * (w["off_centre"] - aligned * w["aligned"]))
    off = lambda ok, c: F.when(ok, F.lit(0.0)).otherwise(c)
    span = (off(in_x, wide * dx / bw) + off(in_y, high * dy / bh)) * w["span"]
    away = (off(in_x, dx / bw) + off(in_y, dy / bh)) * w["gap"]
    good = semantic * w["semantic"] + share * w["overlap"] + close * w["close"] + inside * w["centre"] + F.least(F.lit(1.0), note_area / _one(area(base))) * w["area"]
    return F.when(semantic <= 0, F.lit(0.0)).otherwise(good - outside - span - away)


def touching_spans(envelope: Box, note: Box) -> dict[str, Column]:
    """Along which share of each side of an envelope an annotation touches it; summed per side and capped at 1 they are its support."""
    (ex0, ey0, ex1, ey1), (nx0, ny0, nx1, ny1) = sides(envelope), sides(note)
    w, h = _one(width(envelope)), _one(height(envelope))
    near = F.greatest(F.lit(TOUCH_LEAST), F.least(w, h) * TOUCH)
    up, along = zero(overlap_y(envelope, note)) / h, zero(overlap_x(envelope, note)) / w
    at = lambda edge, lo, hi, span: F.when(F.least(F.abs(lo - edge), F.abs(hi - edge)) <= near, span).otherwise(F.lit(0.0))
    return {"left": at(ex0, nx0, nx1, up), "right": at(ex1, nx0, nx1, up), "top": at(ey0, ny0, ny1, along), "bottom": at(ey1, ny0, ny1, along)}


def unsupported_trim(base: Box, envelope: Box, support: dict[str, Column]) -> Column:
    """The trims of an envelope, each weighed by what its side's support falls short of a fifth."""
    t = trims(base, envelope)
    weighed = [t[s] * zero(SUPPORT_FLOOR - support[s]) / SUPPORT_FLOOR for s in ("left", "top", "right", "bottom")]
    return weighed[0] + weighed[1] + weighed[2] + weighed[3]


def disagreement(first: Column, second: Column, f1_first: Column, f1_second: Column, f1_between: Column) -> Column:
    """How far two systems differ on a page: in F1 against the truth, in numbers (``first``, ``second``), and from each other."""
    return F.abs(f1_first - f1_second) * 100 + F.abs(first - second) * 2 + (1 - f1_between) * 50


def points_box(points: Column) -> tuple[Column, Column, Column, Column]:
    """The box of a list of points, structs of ``x`` and ``y``; null for none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
