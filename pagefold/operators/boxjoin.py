"""Range joins of boxes on a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.geometry import Box, overlap_x, overlap_y

#: How far a box reaches: points, or an expression on the left box's columns ``a_...``.
Reach = float | Column

#: Side of a grid cell in points; the larger, the fewer cells a box is copied to, the smaller, the fewer pairs a dense page tests.
CELL = 256.0
#: Boxes up to which a page is one cell, and dense pages that are told apart; where there are more, every page is cut.
DENSE, MAX_DENSE = 400, 10_000


def _cells(b: Box, axes: str, cell: float) -> Column:
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.greatest(F.floor(lo / cell), F.floor(hi / cell)))
    one = F.array(F.lit(0).cast("bigint"))
    columns, rows = span(b[0], b[2]) if "x" in axes else one, span(b[1], b[3]) if "y" in axes else one
    return F.flatten(F.transform(columns, lambda x: F.transform(rows, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def dense_pages(boxes: DataFrame, on: tuple[str, ...] = ("page_idx",), most: int = DENSE) -> DataFrame | None:
    """Pages of more than ``most`` boxes, counted before the shuffle and small enough to broadcast; None where more than MAX_DENSE are."""
    counted = boxes.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*on)
    n = counted.count()
    return None if n > MAX_DENSE else boxes.sparkSession.createDataFrame(counted.collect() if n else [], boxes.select(*on).schema)


def box_join(left: DataFrame, right: DataFrame, *, reach: Reach | tuple[Reach, Reach] = 0.0, on: tuple[str, ...] = ("page_idx",), where: Column | None = None, axes: str = "xy", how: str = "inner", cell: float = CELL, most: int = DENSE) -> DataFrame:
    """Pairs of boxes of one page that meet when the left one is grown by ``reach`` (sideways, up and down).

    Columns come out prefixed ``a_`` and ``b_``, those of ``on`` plain; ``where`` is tested on them. ``axes`` names the
    axes on which the ranges must meet; on the other one any distance will do. Pages are joined whole, with no copies
    of boxes, but pages where ``right`` is dense are spread over grid cells (of the tested axes) and joined by (page,
    cell), so a page that holds a third of all boxes is split; each pair is kept in the one cell where its intersection
    begins, so nothing comes out twice and nothing is lost. A page or cell that is hot on the left only is linear in
    its rows and split by the adaptive skew join. ``how`` is inner, left_semi or left_anti (left rows, in their own
    columns, need then be unique). Boxes with a null side meet nothing.
    """
    rx, ry = reach if isinstance(reach, tuple) else (reach, reach)
    a = left.select(*on, *[F.col(c).alias(f"a_{c}") for c in left.columns if c not in on])
    b = right.select(*on, *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in on])
    grown = (F.col("a_x0") - rx, F.col("a_y0") - ry, F.col("a_x1") + rx, F.col("a_y1") + ry)
    box_b: Box = (F.col("b_x0"), F.col("b_y0"), F.col("b_x1"), F.col("b_y1"))
    meets = F.lit(True)
    for axis, overlap in (("x", overlap_x), ("y", overlap_y)):
        meets = meets & (overlap(grown, box_b) >= 0) if axis in axes else meets
    dense = dense_pages(right, on, most)
    if dense is not None and dense.isEmpty():
        pairs = a.join(b, list(on)).where(meets)
    else:
        whole = lambda box: box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull()
        nowhere = F.array(F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y")))

        def placed(t: DataFrame, box: Box) -> DataFrame:
            known = t.where(whole(box))
            if dense is None:
                return known.withColumn("_dense", F.lit(True)).withColumn("_cell", F.explode(_cells(box, axes, cell)))
            marked = known.join(F.broadcast(dense.withColumn("_dense", F.lit(True))), list(on), "left").withColumn("_dense", F.col("_dense").isNotNull())
            return marked.withColumn("_cell", F.explode(F.when(F.col("_dense"), _cells(box, axes, cell)).otherwise(nowhere)))

        begins = ~F.col("_dense")
        at = F.lit(True)
        for i, axis in enumerate("xy"):
            at = at & (F.floor(F.greatest(grown[i], box_b[i]) / cell) == F.col(f"_cell.{axis}")) if axis in axes else at
        pairs = placed(a, grown).join(placed(b, box_b).drop("_dense"), [*on, "_cell"]).where(meets & (begins | at)).drop("_dense", "_cell")
    pairs = pairs if where is None else pairs.where(where)
    if how == "inner":
        return pairs
    keys = [*on, *[f"a_{c}" for c in left.columns if c not in on]]
    met = pairs.select(*[F.col(k).alias(f"_met_{i}") for i, k in enumerate(keys)]).distinct()
    test = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_met_{i}")) for i, k in enumerate(keys)])
    return a.join(met, test, how).select(*on, *[F.col(f"a_{c}").alias(c) for c in left.columns if c not in on])


def self_pairs(boxes: DataFrame, *, reach: Reach | tuple[Reach, Reach] = 0.0, where: Column | None = None, on: tuple[str, ...] = ("page_idx",)) -> DataFrame:
    """Each pair of boxes of a page once, the one with the smaller ``ord`` as ``a``."""
    once = F.col("a_ord") < F.col("b_ord")
    return box_join(boxes, boxes, reach=reach, on=on, where=once if where is None else once & where)
