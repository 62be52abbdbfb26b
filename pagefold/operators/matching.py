"""One-to-one matching of two sets of boxes and the metrics built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions.geometry import area, cover_of_first, inter_area, iou, side_errors
from pagefold.operators.boxjoin import box_join
from pagefold.plans.shared import checkpointed

# The limits of strict quality.
STRICT = {"iou": 0.75, "purity": 0.85, "coverage": 0.9, "side": 0.1, "oversized": 1.8, "fragment_coverage": 0.65, "fragment_purity": 0.9}


def scored_pairs(truth: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``page_idx, gt, pred, iou`` of pairs whose IoU reaches ``threshold`` (above 0)."""
    pairs = box_join(truth.select("page_idx", "ord", "x0", "y0", "x1", "y1"), found.select("page_idx", "ord", "x0", "y0", "x1", "y1"))
    return pairs.select("page_idx", F.col("a_ord").alias("gt"), F.col("b_ord").alias("pred"), iou("a_", "b_").alias("iou")).where(F.col("iou") >= threshold)


def greedy_match(pairs: DataFrame) -> DataFrame:
    """The greedy one-to-one matching by (iou descending, gt, pred), as ``page_idx, gt, pred, iou``.

    Under a total order the greedy choice is what rounds of mutual best choice give: a pair that is first for both
    its ends is always taken. Each round takes all of them at once, on all pages, and drops the pairs they block.
    Two rounds settle almost every page; rounds go on until no pair is left. A page of any size stays distributed.
    """
    better = [F.col("iou").desc(), F.col("gt").asc(), F.col("pred").asc()]
    left, taken = pairs, None
    while True:
        ranked = left.withColumns({"_g": F.row_number().over(Window.partitionBy("page_idx", "gt").orderBy(*better)), "_p": F.row_number().over(Window.partitionBy("page_idx", "pred").orderBy(*better))})
        ranked = checkpointed(ranked)
        first = ranked.where("_g = 1 AND _p = 1").drop("_g", "_p")
        if taken is not None and first.isEmpty():  # a round with pairs has a first one
            return taken
        taken = first if taken is None else taken.unionByName(first)
        rest = ranked.where("NOT (_g = 1 AND _p = 1)").drop("_g", "_p")
        left = rest.join(first.select("page_idx", "gt"), ["page_idx", "gt"], "left_anti").join(first.select("page_idx", "pred"), ["page_idx", "pred"], "left_anti").select("page_idx", "gt", "pred", "iou")


def page_counts(spine: DataFrame, truth: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """Per page of ``spine``: counts, precision, recall, F1 and mean IoU of matches, rounded to 4; a page without boxes has zeros."""
    one = lambda t, name: t.groupBy("page_idx").agg(F.count(F.lit(1)).alias(name))
    m = matches.groupBy("page_idx").agg(F.count(F.lit(1)).alias("match_count"), F.sum(F.round("iou", 4).cast("decimal(12,4)")).alias("_iou"))
    out = spine.join(one(truth, "gt_count"), "page_idx", "left").join(one(found, "prediction_count"), "page_idx", "left").join(m, "page_idx", "left")
    out = out.na.fill(0, ["gt_count", "prediction_count", "match_count"])
    return out.withColumns(rates()).withColumn("iou", mean4("_iou", "match_count")).drop("_iou")


def mean4(total: str, n: str) -> Column:
    """An exact decimal total over a count, rounded half up to 4 digits; 0 for a count of 0."""
    exact = F.coalesce(F.col(total), F.lit(0)).cast("decimal(22,4)") / F.col(n).cast("decimal(12,0)")
    return F.when(F.col(n) > 0, F.round(exact, 4).cast("double")).otherwise(F.lit(0.0))


def rates(gt: str = "gt_count", found: str = "prediction_count", match: str = "match_count") -> dict:
    p = F.when(F.col(found) > 0, F.col(match) / F.col(found)).otherwise(F.lit(0.0))
    r = F.when(F.col(gt) > 0, F.col(match) / F.col(gt)).otherwise(F.lit(0.0))
    f = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return {"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f, 4)}


def micro(results: DataFrame, *keys: str) -> DataFrame:
    """Micro aggregate of page results by ``keys`` (none: one row); IoU weighs the rounded page means by matches."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    weighted = F.sum((F.col("iou").cast("decimal(12,4)") * F.col("match_count")).cast("decimal(30,4)"))
    out = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("page_count"), total("gt_count"), total("prediction_count"), total("match_count"), weighted.alias("_w"))
    out = out.withColumns(rates("total_gt_count", "total_prediction_count", "total_match_count"))
    return out.withColumn("iou", mean4("_w", "total_match_count")).drop("_w")


def grouped_micro(results: DataFrame, *keys: str) -> DataFrame:
    """Micro aggregates for each key on its own and for all pages, in one pass by grouping sets; a blank key is ``unknown``."""
    named = results.withColumns({k: F.coalesce(F.nullif(F.trim(k), F.lit("")), F.lit("unknown")) for k in keys})
    weighted = (F.col("iou").cast("decimal(12,4)") * F.col("match_count")).cast("decimal(30,4)")
    out = named.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.count(F.lit(1)).alias("page_count"), *[F.sum(c).alias(f"total_{c}") for c in ("gt_count", "prediction_count", "match_count")], F.sum(weighted).alias("_w")
    )
    out = out.withColumns(rates("total_gt_count", "total_prediction_count", "total_match_count"))
    return out.withColumn("iou", mean4("_w", "total_match_count")).drop("_w")


def strict_rows(truth: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """A row per match, unmatched prediction (with the truth box it overlaps most) and unmatched truth box, with its flags.

    ``status`` is MATCH, FP or MISS. A false positive is measured against the nearest truth box of its page (none: an
    empty box); a miss has no measures.
    """
    box = ("x0", "y0", "x1", "y1")
    named = lambda t, key, p: t.select("page_idx", F.col("ord").alias(key), *[F.col(c).alias(f"{p}{c}") for c in box])
    g, p = named(truth, "gt", "g_"), named(found, "pred", "p_")
    hit = matches.select("page_idx", "gt", "pred").join(g, ["page_idx", "gt"]).join(p, ["page_idx", "pred"]).withColumn("status", F.lit("MATCH"))
    lone = found.join(matches.select("page_idx", F.col("pred").alias("ord")), ["page_idx", "ord"], "left_anti").select("page_idx", "ord", *box)
    near = box_join(lone, truth.select("page_idx", "ord", *box)).withColumn("_iou", iou("a_", "b_")).where("_iou > 0")
    near = near.groupBy("page_idx", F.col("a_ord").alias("pred")).agg(F.max_by(F.struct(*[F.col(f"b_{c}").alias(f"g_{c}") for c in box]), F.struct("_iou", -F.col("b_ord"))).alias("_n"))
    fp = named(lone, "pred", "p_").join(near, ["page_idx", "pred"], "left").select("page_idx", "pred", F.lit(None).cast("int").alias("gt"), *[f"p_{c}" for c in box], *[F.coalesce(F.col(f"_n.g_{c}"), F.lit(0.0)).alias(f"g_{c}") for c in box], F.lit("FP").alias("status"))
    miss = truth.join(matches.select("page_idx", F.col("gt").alias("ord")), ["page_idx", "ord"], "left_anti").select("page_idx", F.col("ord").alias("gt"), F.lit("MISS").alias("status"))
    rows = hit.unionByName(fp)
    errors = side_errors("p_", "g_")
    known = area("g_") > 0
    measured = rows.withColumns({"iou": iou("p_", "g_"), "purity": cover_of_first("p_", "g_"), "coverage": cover_of_first("g_", "p_"), "area_ratio": F.when(known, area("p_") / area("g_")).otherwise(F.lit(0.0)), **{k: F.when(known, v).otherwise(F.lit(0.0)) for k, v in errors.items()}})
    hit_row = F.col("status") == "MATCH"
    flags = [
        F.when(F.col("status") == "FP", "fp"),
        F.when(hit_row & (F.col("iou") < STRICT["iou"]), "low_iou_match"),
        F.when(F.col("purity") < STRICT["purity"], "low_pred_purity"),
        F.when(hit_row & (F.col("coverage") < STRICT["coverage"]), "low_gt_coverage"),
        *[F.when(F.col(e) > STRICT["side"], e) for e in errors],
        F.when(F.col("area_ratio") > STRICT["oversized"], "oversized_box"),
        F.when((F.col("coverage") < STRICT["fragment_coverage"]) & (F.col("purity") > STRICT["fragment_purity"]), "inside_gt_fragment_or_legend"),
    ]
    out = measured.select("page_idx", "status", "gt", "pred", *[F.round(c, 4).alias(c) for c in ("iou", "purity", "coverage", "area_ratio")], F.array_join(F.array_compact(F.array(*flags)), "|").alias("flags"))
    zeros = {c: F.lit(0.0) for c in ("iou", "purity", "coverage", "area_ratio")}
    return out.unionByName(miss.withColumns({**zeros, "pred": F.lit(None).cast("int"), "flags": F.lit("miss")}))


def structure(truth: DataFrame, found: DataFrame, spine: DataFrame) -> DataFrame:
    """Fragmentation (both definitions), overmerge, contamination and completeness per page.

    ``truth`` has ``group_id`` and ``panels`` (a count); ``found`` has ``group_ids`` (array), ``panels`` and ``excluded``
    (the summed area of body text inside). Extra predictions of a group are fragments: ``fragmentation`` counts each
    truth row, ``fragmentation_distinct`` each group once by the first id of a prediction.
    """
    held = found.select("page_idx", F.explode("group_ids").alias("group_id"), "panels", "ord", *["x0", "y0", "x1", "y1"])
    many = held.groupBy("page_idx", "group_id").agg(F.count(F.lit(1)).alias("_n"))
    first = found.where(F.size("group_ids") > 0).groupBy("page_idx", F.col("group_ids")[0].alias("group_id")).agg(F.count(F.lit(1)).alias("_m"))
    extra = lambda c: F.greatest(F.coalesce(c, F.lit(0)) - 1, F.lit(0))
    rows = truth.join(many, ["page_idx", "group_id"], "left").groupBy("page_idx").agg(F.count(F.lit(1)).alias("gt_count"), F.sum(extra(F.col("_n"))).alias("_extra"))
    groups = truth.select("page_idx", "group_id").distinct().join(first, ["page_idx", "group_id"], "left").groupBy("page_idx").agg(F.sum(extra(F.col("_m"))).alias("_once"))
    both = truth.alias("t").join(held.alias("h"), ["page_idx", "group_id"]).select("page_idx", F.col("t.ord").alias("gt"), F.col("t.panels").alias("want"), F.col("h.panels").alias("have"), F.col("h.ord").alias("pred"), iou(tuple(F.col(f"t.{c}") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"h.{c}") for c in ("x0", "y0", "x1", "y1"))).alias("_iou"))
    best = both.groupBy("page_idx", "gt").agg(F.max_by(F.struct("want", "have"), F.struct("_iou", -F.col("pred"))).alias("b"))
    complete = best.groupBy("page_idx").agg(F.sum(F.when(F.col("b.want") == 0, F.lit(1.0)).otherwise(F.round(F.least("b.want", "b.have") / F.col("b.want"), 4)).cast("decimal(12,4)")).alias("_parts"))
    pred = found.groupBy("page_idx").agg(F.count(F.lit(1)).alias("prediction_count"), F.sum((F.size("group_ids") > 1).cast("int")).alias("_merged"), F.sum(F.when(area("") > 0, F.round(F.col("excluded") / area(""), 4)).otherwise(F.lit(0.0)).cast("decimal(14,4)")).alias("_dirty"))
    out = spine.select("page_idx").join(rows, "page_idx", "left").join(groups, "page_idx", "left").join(complete, "page_idx", "left").join(pred, "page_idx", "left").na.fill(0)
    return out.select("page_idx", "gt_count", "prediction_count", mean4("_extra", "gt_count").alias("fragmentation"), mean4("_once", "gt_count").alias("fragmentation_distinct"), mean4("_merged", "prediction_count").alias("overmerge"), mean4("_dirty", "prediction_count").alias("contamination"), mean4("_parts", "gt_count").alias("completeness"))


def intersections(pairs: DataFrame) -> DataFrame:
    """Areas of intersection and union of prefixed pairs."""
    i = inter_area("a_", "b_")
    return pairs.withColumns({"inter": i, "whole": area("a_") + area("b_") - i})
