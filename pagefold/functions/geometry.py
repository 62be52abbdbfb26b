"""Boxes as four double columns x0, y0, x1, y1 (y grows downward). A box argument is a prefix of its columns or a tuple of Columns.

Overlap measures are 0 unless the overlap is positive on both axes; ``ranges_touch`` alone counts touching. Three
coverages differ in what they divide by, hence three names. A null coordinate makes every measure null or false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = str | tuple[Column, Column, Column, Column]


def sides(b: Box) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{b}{c}") for c in ("x0", "y0", "x1", "y1")) if isinstance(b, str) else b


def zero(c: Column) -> Column:
    """The value, 0 at least; null stays null."""
    return F.when(c.isNotNull(), _least0(c))


def _least0(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def _known(value: Column, *parts: Column) -> Column:
    """``greatest`` and ``least`` skip nulls: a measure with an unknown part is unknown.

    Measures test their sides once, at the top, around a formula that names each part as seldom as it can: a filter
    evaluates every copy of a part again.
    """
    test = parts[0].isNotNull()
    for p in parts[1:]:
        test = test & p.isNotNull()
    return F.when(test, value)


def width(b: Box) -> Column:
    x0, _, x1, _ = sides(b)
    return x1 - x0


def height(b: Box) -> Column:
    _, y0, _, y1 = sides(b)
    return y1 - y0


def _area(b: Box) -> Column:
    return _least0(width(b)) * _least0(height(b))


def area(b: Box) -> Column:
    return _known(_area(b), *sides(b))


def _ox(a: Box, b: Box) -> Column:
    (ax0, _, ax1, _), (bx0, _, bx1, _) = sides(a), sides(b)
    return F.least(ax1, bx1) - F.greatest(ax0, bx0)


def _oy(a: Box, b: Box) -> Column:
    (_, ay0, _, ay1), (_, by0, _, by1) = sides(a), sides(b)
    return F.least(ay1, by1) - F.greatest(ay0, by0)


def overlap_x(a: Box, b: Box) -> Column:
    (ax0, _, ax1, _), (bx0, _, bx1, _) = sides(a), sides(b)
    return _known(_ox(a, b), ax0, ax1, bx0, bx1)


def overlap_y(a: Box, b: Box) -> Column:
    (_, ay0, _, ay1), (_, by0, _, by1) = sides(a), sides(b)
    return _known(_oy(a, b), ay0, ay1, by0, by1)


def _inter(a: Box, b: Box) -> Column:
    return _least0(_ox(a, b)) * _least0(_oy(a, b))


def inter_area(a: Box, b: Box) -> Column:
    return _known(_inter(a, b), *sides(a), *sides(b))


def ranges_touch(a: Box, b: Box) -> Column:
    return (overlap_x(a, b) >= 0) & (overlap_y(a, b) >= 0)


def _share(part: Column, whole: Column, a: Box, b: Box) -> Column:
    """Part over whole, 0 for a whole of 0."""
    return _known(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), *sides(a), *sides(b))


def iou(a: Box, b: Box) -> Column:
    return _share(_inter(a, b), _area(a) + _area(b) - _inter(a, b), a, b)


def cover_of_first(a: Box, b: Box) -> Column:
    """Intersection over the area of ``a``."""
    return _share(_inter(a, b), _area(a), a, b)


def cover_of_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return _share(_inter(a, b), F.least(_area(a), _area(b)), a, b)


def gap(a: Box, b: Box) -> Column:
    """Distance between the boxes, 0 where they meet."""
    dx, dy = _least0(-_ox(a, b)), _least0(-_oy(a, b))
    return _known(F.sqrt(dx * dx + dy * dy), *sides(a), *sides(b))


def clipped(b: Box, w: float, h: float) -> tuple[Column, Column, Column, Column]:
    """The box inside a page of ``w`` x ``h``; never turned inside out."""
    x0, y0, x1, y1 = sides(b)
    inside = lambda c, m: F.least(zero(c), F.lit(float(m)))
    a, t = inside(x0, w), inside(y0, h)
    return a, t, F.greatest(a, F.least(x1, F.lit(float(w)))), F.greatest(t, F.least(y1, F.lit(float(h))))


def padded(b: Box, by: Column | float, w: float, h: float) -> tuple[Column, Column, Column, Column]:
    x0, y0, x1, y1 = sides(b)
    by = F.lit(float(by)) if not isinstance(by, Column) else by
    return zero(x0 - by), zero(y0 - by), F.least(x1 + by, F.lit(float(w))), F.least(y1 + by, F.lit(float(h)))


def edges_touched(b: Box, w: float, h: float, tolerance: float) -> Column:
    """How many of the page's four edges lie within ``tolerance``."""
    x0, y0, x1, y1 = sides(b)
    near = (x0 <= tolerance, y0 <= tolerance, x1 >= w - tolerance, y1 >= h - tolerance)
    total = F.lit(0)
    for c in near:
        total = total + c.cast("int")
    return total


def aspect(b: Box) -> Column:
    """Longer over shorter side; sides below 1 count as 1."""
    w, h = F.greatest(width(b), F.lit(1.0)), F.greatest(height(b), F.lit(1.0))
    return F.greatest(w, h) / F.least(w, h)


def normalised(b: Box, w: float, h: float, digits: int = 3) -> Column:
    """Key of a box that repeats on pages of one size: coordinates over the page's, rounded."""
    x0, y0, x1, y1 = sides(b)
    w, h = max(w, 1.0), max(h, 1.0)
    return F.concat_ws(",", *[F.format_string(f"%.{digits}f", F.round(c / m, digits)) for c, m in ((x0, w), (y0, h), (x1, w), (y1, h))])


def scaled(b: Box, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> tuple[Column, ...]:
    """From one space to another, rounded to 4 digits; zeros where a size isn't positive."""
    good = (from_w > 0) & (from_h > 0) & (to_w > 0) & (to_h > 0)
    put = lambda c, f, t: F.when(good, F.round(c / f * t, 4)).otherwise(F.lit(0.0))
    x0, y0, x1, y1 = sides(b)
    return put(x0, from_w, to_w), put(y0, from_h, to_h), put(x1, from_w, to_w), put(y1, from_h, to_h)


def side_errors(p: Box, g: Box) -> dict[str, Column]:
    """What ``p`` crops from ``g`` and reaches over it, per side, over the size of ``g`` (1 at least)."""
    (px0, py0, px1, py1), (gx0, gy0, gx1, gy1) = sides(p), sides(g)
    w, h = F.greatest(width(g), F.lit(1.0)), F.greatest(height(g), F.lit(1.0))
    inward = {"left": (px0 - gx0, w), "top": (py0 - gy0, h), "right": (gx1 - px1, w), "bottom": (gy1 - py1, h)}
    return {f"crop_{s}": zero(d) / m for s, (d, m) in inward.items()} | {f"over_{s}": zero(-d) / m for s, (d, m) in inward.items()}


def same_row(a: Box, b: Box, least: float = 0.4) -> Column:
    """Vertical overlap of at least ``least`` of the lower height."""
    o = overlap_y(a, b)
    return (o > 0) & (o / F.greatest(F.least(height(a), height(b)), F.lit(1.0)) >= least)


def same_column(a: Box, b: Box, least: float = 0.4) -> Column:
    o = overlap_x(a, b)
    return (o > 0) & (o / F.greatest(F.least(width(a), width(b)), F.lit(1.0)) >= least)


def saturation(v: Column, start: float, end: float) -> Column:
    """0 up to ``start``, 1 from ``end``, straight between."""
    return F.least(zero((v - start) / (end - start)), F.lit(1.0))


def soft_count(n: Column, pivot: float) -> Column:
    return F.when(n > 0, n / (n + pivot)).otherwise(F.lit(0.0))
