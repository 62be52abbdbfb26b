"""Summaries of runs: timings, comparisons, error clusters, counts of a dataset and its gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.operators.matching import mean4, rates
from pagefold.plans.partitioning import ordered_positions
from pagefold.plans.shared import stored


def timing(samples: DataFrame, value: str, key: str) -> DataFrame:
    """Count, total, interpolated p50 and p95, greatest and least per key; null values don't count.

    The percentiles are the values at two ranks of a range sort, so a key of any size is spread and none is gathered.
    """
    known = stored(samples.select(key, value).where(F.col(value).isNotNull()))
    stats = known.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.round(F.sum(F.col(value).cast("decimal(18,4)")), 4).alias("total"), F.max(value).alias("max"), F.min(value).alias("min"))
    sized = stats.select(F.col(key).alias("_k"), *[((F.col("count") - 1) * p).alias(f"_{n}") for n, p in (("p50", 0.5), ("p95", 0.95))])
    ranked = ordered_positions(known, key, [F.col(value).asc()], cheap=True).join(sized, F.col(key).eqNullSafe(F.col("_k")))
    at = lambda end, n: F.max(F.when(F.col("group_pos") == end(f"_{n}").cast("long"), F.col(value)))
    two = ranked.groupBy(key).agg(*[f.alias(x) for n in ("p50", "p95") for f, x in ((at(F.floor, n), f"_lo_{n}"), (at(F.ceil, n), f"_hi_{n}"), (F.first(f"_{n}"), f"_at_{n}"))])
    part = lambda n: F.col(f"_at_{n}") - F.floor(f"_at_{n}")
    between = lambda n: F.round(F.col(f"_lo_{n}") * (1 - part(n)) + F.col(f"_hi_{n}") * part(n), 6).alias(n)
    two = two.select(F.col(key).alias("_k"), between("p50"), between("p95"))
    return stats.join(two, F.col(key).eqNullSafe(F.col("_k"))).select(key, "count", "total", "p50", "p95", "max", "min")


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages of either run with their figures, the difference, and whether figures were gained, lost, kept or never there."""
    a, b = before.withColumnRenamed("figures", "_a"), after.withColumnRenamed("figures", "_b")
    out = a.join(b, "page_idx", "full").select("page_idx", F.coalesce("_a", F.lit(0)).alias("before"), F.coalesce("_b", F.lit(0)).alias("after"))
    had, has = F.col("before") > 0, F.col("after") > 0
    return out.withColumn("delta", F.col("after") - F.col("before")).withColumn("change", F.when(~had & has, "gained").when(had & ~has, "lost").when(had, "kept").otherwise("unchanged"))


def cluster_key() -> Column:
    return F.concat(F.col("family"), F.lit("|"), F.col("difficulty"), F.lit("|gt="), F.col("gt_count").cast("string"), F.lit("|pred="), F.col("prediction_count").cast("string"))


def cluster_errors(results: DataFrame) -> DataFrame:
    """Pages grouped by labels and counts: cluster key, size, first and last page."""
    return results.groupBy(cluster_key().alias("cluster_key")).agg(F.count(F.lit(1)).alias("page_count"), F.max("gt_count").alias("gt_count"), F.min("page_idx").alias("first_page"), F.max("page_idx").alias("last_page"))


def cluster_members(results: DataFrame) -> DataFrame:
    """The pages of each cluster, numbered from 1 in their order; a cluster is a run of rows, never one value."""
    keyed = results.select("page_idx", cluster_key().alias("cluster_key"))
    return ordered_positions(keyed, "cluster_key", [F.col("page_idx").asc()]).select("cluster_key", "page_idx", (F.col("group_pos") + 1).alias("nth"))


def overview(pages: DataFrame, document: str) -> DataFrame:
    """Per document: pages, figures, mean contamination over pages with figures, greatest overmerge."""
    with_figures = F.when(F.col("figures") > 0, F.col("contamination"))
    return pages.groupBy(document).agg(F.count(F.lit(1)).alias("pages"), F.sum("figures").alias("figures"), F.round(F.coalesce(F.avg(with_figures), F.lit(0.0)), 4).alias("mean_contamination"), F.max("overmerge").alias("max_overmerge"))


def recount(pages: DataFrame, negative: str = "hard_negative") -> DataFrame:
    """One row: pages, positive and negative ones, distinct documents and label pairs."""
    is_negative = F.coalesce(F.col("family") == negative, F.lit(False))
    return pages.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(~is_negative).alias("positive"), F.count_if(is_negative).alias("negative"), F.countDistinct("paper").alias("papers"), F.countDistinct(F.concat_ws("|", F.coalesce("family", F.lit("unknown")), F.coalesce("level", F.lit("unknown")))).alias("buckets")
    )


def missing_parts(pages: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """``key, reason`` for each page without a row in a part: one anti join per part, sorted and merged."""
    found = [pages.select(key).distinct().join(t.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").withColumn("reason", F.lit(f"missing_{name}")) for name, t in parts.items()]
    return reduce(DataFrame.unionByName, found)


def benchmark_means(pages: DataFrame) -> DataFrame:
    """One row over pages of structural metrics: counts, totals, and the mean of each rate over pages, rounded to 4; zeros for no page."""
    exact = lambda c: F.round(F.coalesce(F.sum(F.col(c).cast("decimal(14,4)")) / F.count(c), F.lit(0)), 4).cast("double")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    return pages.agg(F.count(F.lit(1)).alias("page_count"), total("gt_count"), total("prediction_count"), *[exact(c).alias(f"mean_{c}") for c in ("fragmentation", "contamination", "overmerge", "completeness")])


def review_queue(overview: DataFrame) -> DataFrame:
    """Rows of an overview that need a look, with the first reason: contamination, else overmerge."""
    reason = F.when(F.col("mean_contamination") > 0, "contamination").when(F.col("max_overmerge") > 0, "overmerge")
    return overview.withColumn("review_reason", reason).where("review_reason IS NOT NULL")


def run_summaries(pages: DataFrame, images: DataFrame, modes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per run: pages, figures, pages with figures (how many, first, last), images, and the mode: the first of ``modes`` of which a page has a stage, else unknown.

    ``pages`` has ``run, page_idx, figures, stages`` (an array); ``images`` has ``run``, a row per image.
    """
    hit = F.when(F.col("figures") > 0, F.col("page_idx"))
    has = {m: F.bool_or(F.arrays_overlap("stages", F.array(*[F.lit(s) for s in stages]))).alias(f"_{m}") for m, stages in modes.items()}
    per = pages.groupBy("run").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("figures"), F.lit(0)).alias("figures"), F.count(hit).alias("hit_pages"), F.min(hit).alias("first_hit"), F.max(hit).alias("last_hit"), *has.values())
    mode = F.lit("unknown")
    for m in reversed(modes):
        mode = F.when(F.col(f"_{m}"), m).otherwise(mode)
    counted = images.groupBy("run").agg(F.count(F.lit(1)).alias("images"))
    return per.join(counted, "run", "left").select("run", mode.alias("mode"), "pages", "figures", "hit_pages", "first_hit", "last_hit", F.coalesce("images", F.lit(0)).alias("images"))


def compare_systems(pages: DataFrame, key: str, first: str, second: str, agreement: str | None = None) -> DataFrame:
    """Micro metrics of two systems by ``key`` (blank: unknown) with the difference in F1, and how far they agree.

    ``pages`` has ``gt_count`` and, for each system, ``<name>_prediction_count``, ``<name>_match_count`` and ``<name>_iou``.
    The agreement takes the first system for the truth.
    """
    named = pages.withColumn(key, F.coalesce(F.nullif(F.trim(key), F.lit("")), F.lit("unknown")))
    weigh = lambda p: F.sum((F.col(f"{p}_iou").cast("decimal(12,4)") * F.col(f"{p}_match_count")).cast("decimal(30,4)")).alias(f"_{p}_w")
    names = [n for n in (first, second, agreement) if n]
    sums = [F.sum(c).alias(c) for c in ("gt_count", *[f"{n}_match_count" for n in names], f"{first}_prediction_count", f"{second}_prediction_count")]
    out = named.groupBy(key).agg(F.count(F.lit(1)).alias("page_count"), *sums, *[weigh(n) for n in names])
    for n in names:
        gt, found = ("gt_count", f"{n}_prediction_count") if n != agreement else (f"{first}_prediction_count", f"{second}_prediction_count")
        out = out.withColumns({f"{n}_{k}": v for k, v in rates(gt, found, f"{n}_match_count").items()})
        out = out.withColumn(f"{n}_iou", mean4(f"_{n}_w", f"{n}_match_count")).drop(f"_{n}_w")
    return out.withColumn("delta_f1", F.round(F.col(f"{second}_f1") - F.col(f"{first}_f1"), 4))


# Weights of a page's problems, and below which F1 a page is one.
PROBLEM = {"complete": 100, "miss": 20, "group": 10, "extra": 8}
LOW_F1 = 0.95


def page_problems(pages: DataFrame) -> DataFrame:
    """Per page what a system misses (``misses``), adds (``extras``), the problems in order and a score to sort by: complete misses first."""
    miss, extra = F.greatest(F.lit(0), F.col("gt_count") - F.col("match_count")), F.greatest(F.lit(0), F.col("prediction_count") - F.col("match_count"))
    none, group = (F.col("gt_count") > 0) & (F.col("match_count") == 0), (F.col("gt_count") > 1) & (miss > 0)
    reasons = F.array_compact(F.array(F.when(none, "nothing matched").when(miss > 0, "missed"), F.when(group, "group incomplete"), F.when(extra > 0, "extra"), F.when((F.col("f1") > 0) & (F.col("f1") < LOW_F1), "low f1")))
    num = lambda c: c.cast("int")
    score = num(none) * PROBLEM["complete"] + miss * PROBLEM["miss"] + num(group) * PROBLEM["group"] + extra * PROBLEM["extra"] + F.greatest(F.lit(0.0), 1 - F.col("f1"))
    return pages.select("page_idx", miss.alias("misses"), extra.alias("extras"), F.when(F.size(reasons) > 0, F.array_join(reasons, "|")).otherwise("none").alias("problems"), F.round(score, 4).alias("problem_score"))


# Beginnings of captions, numbers and confidences of the first sorting of pages.
CAPTION_WORDS = ("图", "fig", "Fig", "FIG", "Figure", "figure")
PAGE_SURE = {"both": 0.65, "vector": 0.7, "panels": 0.65, "raster": 0.4, "unknown": 0.25, "flow": 0.6, "many": 0.6, "empty": 0.3}
MANY_PANELS, STRESS_PANELS, DENSE, VERY_DENSE = 3, 5, 40, 80


def page_signals(elements: DataFrame, figures: DataFrame, keywords: Column) -> DataFrame:
    """Per page the numbers of figures, panels and elements by kind, of caption-like texts, and whether a text has a flow ``keyword``; combined before the shuffle."""
    like = F.lit(False)
    for w in CAPTION_WORDS:
        like = like | F.ltrim(F.coalesce("text", F.lit(""))).startswith(w)
    k, text = F.col("kind"), F.col("kind") == "text_block"
    seen = elements.groupBy("page_idx").agg(F.count_if(k == "vector_cluster").alias("vectors"), F.count_if(k == "raster_image").alias("rasters"), F.count(F.lit(1)).alias("elements"), F.count_if(text & like).alias("captions"), F.coalesce(F.bool_or(text & keywords), F.lit(False)).alias("flow"))
    return seen.join(figures.groupBy("page_idx").agg(F.count(F.lit(1)).alias("figures"), F.coalesce(F.sum("panels"), F.lit(0)).alias("panels")), "page_idx", "left").na.fill(0, ["figures", "panels"])


def sort_page(multi_column: Column | None = None) -> dict[str, Column]:
    """``family, difficulty, confidence, reasons`` of a page by its signals: a first sorting, unsure where little is known."""
    c, s = F.col, PAGE_SURE
    columns = F.lit(False) if multi_column is None else multi_column
    panels, figures, both = c("panels"), c("figures"), (c("vectors") > 0) & (c("rasters") > 0)
    several = (panels >= 2) | (figures >= 2)
    base = F.when(both, "mixed_vector_raster").when(c("vectors") > 0, "vector_dominant").when(c("rasters") > 0, F.when(several, "compound_multi_panel").otherwise("mixed_vector_raster")).otherwise("unknown")
    sure = F.when(both, s["both"]).when(c("vectors") > 0, s["vector"]).when(c("rasters") > 0, F.when(several, s["panels"]).otherwise(s["raster"])).when(figures > 0, s["unknown"]).otherwise(F.lit(0.0))
    flow = c("flow") & (figures > 0)
    many = ~flow & (panels >= MANY_PANELS) & (base != "compound_multi_panel")
    family = F.when(figures == 0, "unknown").when(flow, "route_map_or_flow").when(many, "compound_multi_panel").otherwise(base)
    confidence = F.when(figures == 0, s["empty"]).when(flow, F.greatest(sure, F.lit(s["flow"]))).when(many, F.greatest(sure, F.lit(s["many"]))).otherwise(sure)
    dense = (c("captions") > 0) & (c("elements") > DENSE)
    hard = (figures >= 2) | ((figures > 0) & (columns | dense))
    stress = (c("elements") > VERY_DENSE) | (panels >= STRESS_PANELS)
    said = lambda test, *parts: F.when(test, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    raster_only = ~both & (c("vectors") == 0) & (c("rasters") > 0)
    reasons = [
        said(both, "vector=", c("vectors"), ";raster=", c("rasters")), said(~both & (c("vectors") > 0), "vector_only=", c("vectors")), said(raster_only & several, "raster_multi_panel=", panels, ";figs=", figures), said(raster_only & ~several, "raster_single=", c("rasters")),
        said((c("vectors") == 0) & (c("rasters") == 0) & (figures > 0), "no_atom_kind_breakdown"), said(flow, "flow_keyword_detected"), said(many, "high_panel_count=", panels),
        F.when(figures == 0, "no_figures").when(figures >= 2, F.concat(F.lit("multi_figure_page="), figures.cast("string"))).when(columns, "multi_column_span").when(dense, F.concat(F.lit("dense_page_with_caption;atoms="), c("elements").cast("string"))),
        said(c("elements") > VERY_DENSE, "very_dense_page;atoms=", c("elements")), said(panels >= STRESS_PANELS, "many_panels=", panels), said(figures == 0, "page_has_no_figures"),
    ]
    return {"family": family, "difficulty": F.when(stress, "stress").when(hard, "hard").otherwise("control"), "confidence": F.round(confidence, 2), "reasons": F.array_join(F.array_compact(F.array(*reasons)), ";")}
