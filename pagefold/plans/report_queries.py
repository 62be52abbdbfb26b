"""Queries of summaries: benchmark means, review queues, runs, two systems side by side, problems and first sortings of pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions.text import has_keyword
from pagefold.operators import reports as r
from pagefold.plans.layout_queries import _F1, _PAGES_RESULT, QUERIES as LAYOUT, SQL as LAYOUT_SQL, WITH_ATOMS, round_sql
from pagefold.sources.layouts import atoms, predictions, stored_atoms
from pagefold.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_RATES = ("fragmentation", "contamination", "overmerge", "completeness")


@query(f"SELECT count(*) AS page_count, sum(gt_count) AS total_gt_count, sum(prediction_count) AS total_prediction_count, {', '.join(f'((2 * CAST(sum(CAST({c} AS DECIMAL(14,4))) * 10000 AS BIGINT) + count(*)) // (2 * count(*))) / 10000 AS mean_{c}' for c in _RATES)} FROM ({LAYOUT_SQL['page_structure']})")
def benchmark_means(spark: SparkSession, d: str) -> DataFrame:
    return r.benchmark_means(LAYOUT["page_structure"](spark, d))


_OVERVIEW = f"""SELECT doc_id % 97 AS doc_id, count(*) AS pages, sum(prediction_count) AS figures, round(coalesce(avg(contamination) FILTER (prediction_count > 2), 0.0), 4) AS mean_contamination, max(overmerge) FILTER (prediction_count > 1) AS max_overmerge FROM ({LAYOUT_SQL['page_structure']}) s JOIN (SELECT o_orderkey AS page_idx, o_custkey AS doc_id FROM orders) USING (page_idx) GROUP BY 1"""


@query(f"SELECT doc_id, pages, figures, max_overmerge, CASE WHEN mean_contamination > 0 THEN 'contamination' WHEN max_overmerge > 0 THEN 'overmerge' END AS review_reason FROM ({_OVERVIEW}) WHERE mean_contamination > 0 OR max_overmerge > 0")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_idx"), (F.col("o_custkey") % 97).alias("doc_id"))
    per = LAYOUT["page_structure"](spark, d).join(docs, "page_idx")
    overview = per.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("prediction_count").alias("figures"), F.coalesce(F.avg(F.when(F.col("prediction_count") > 2, F.col("contamination"))), F.lit(0.0)).alias("mean_contamination"), F.max(F.when(F.col("prediction_count") > 1, F.col("overmerge"))).alias("max_overmerge"))
    return r.review_queue(overview).drop("mean_contamination")


@query(
    f"""{WITH_ATOMS}, p AS (SELECT page_idx % 7 AS run, page_idx, count(*) FILTER (kind = 'raster_image') AS figures FROM atoms GROUP BY 1, 2), i AS (SELECT page_idx % 7 AS run, count(*) AS images FROM preds WHERE kind = 'raster_image' AND page_idx % 7 <> 6 GROUP BY 1)
 SELECT run, CASE WHEN run % 3 = 0 THEN 'closures' WHEN run % 3 = 1 THEN 'graph' ELSE 'unknown' END AS mode, count(*) AS pages, sum(figures) AS figures, count(*) FILTER (figures > 0) AS hit_pages, min(page_idx) FILTER (figures > 0) AS first_hit, max(page_idx) FILTER (figures > 0) AS last_hit, coalesce(any_value(images), 0) AS images FROM p LEFT JOIN i USING (run) GROUP BY run"""
)
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    run = (F.col("page_idx") % 7).alias("run")
    pages = atoms(spark, d).groupBy("page_idx").agg(F.count_if(F.col("kind") == "raster_image").alias("figures"))
    stages = F.when(F.col("page_idx") % 7 % 3 == 0, F.array(F.lit("edges"), F.lit("ranked"))).when(F.col("page_idx") % 7 % 3 == 1, F.array(F.lit("edges"))).otherwise(F.array().cast("array<string>"))
    images = predictions(spark, d).where("kind = 'raster_image' AND page_idx % 7 <> 6").select(run)
    return r.run_summaries(pages.select(run, "page_idx", "figures", stages.alias("stages")), images, {"closures": ("ranked", "seeds"), "graph": ("edges",)})


_TWO = "SELECT *, prediction_count AS one_prediction_count, match_count AS one_match_count, iou AS one_iou, prediction_count + page_idx % 2 AS two_prediction_count, greatest(match_count - page_idx % 3, 0) AS two_match_count, iou AS two_iou, least(match_count, 1) AS both_match_count, iou AS both_iou FROM res"


def _system_sql(n: str, gt: str, found: str) -> str:
    p, q = f"(CASE WHEN {found} > 0 THEN {n}_match_count / {found} ELSE 0.0 END)", f"(CASE WHEN {gt} > 0 THEN {n}_match_count / {gt} ELSE 0.0 END)"
    f1 = _F1.replace("2 * p * r / (p + r)", f"2 * {p} * {q} / ({p} + {q})").replace("p > 0 AND r > 0", f"{p} > 0 AND {q} > 0")
    return f"{round_sql(p)} AS {n}_precision, {round_sql(q)} AS {n}_recall, {round_sql('(' + f1 + ')')} AS {n}_f1, CASE WHEN {n}_match_count > 0 THEN ((2 * CAST({n}_w * 10000 AS BIGINT) + {n}_match_count) // (2 * {n}_match_count)) / 10000 ELSE 0.0 END AS {n}_iou"


@query(
    f"""{_PAGES_RESULT}, t AS ({_TWO}), g AS (SELECT family, count(*) AS page_count, sum(gt_count) AS gt_count, {', '.join(f'sum({n}_match_count) AS {n}_match_count, sum(CAST({n}_iou AS DECIMAL(12,4)) * {n}_match_count) AS {n}_w' for n in ('one', 'two', 'both'))}, sum(one_prediction_count) AS one_prediction_count, sum(two_prediction_count) AS two_prediction_count FROM t GROUP BY 1),
 m AS (SELECT *, {_system_sql('one', 'gt_count', 'one_prediction_count')}, {_system_sql('two', 'gt_count', 'two_prediction_count')}, {_system_sql('both', 'one_prediction_count', 'two_prediction_count')} FROM g)
 SELECT * EXCLUDE (one_w, two_w, both_w), {round_sql('two_f1 - one_f1')} AS delta_f1 FROM m"""
)
def system_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two systems by family and their agreement; the second one made of the first."""
    c = F.col
    two = LAYOUT["page_metrics"](spark, d).select(
        "page_idx", "family", "gt_count", c("prediction_count").alias("one_prediction_count"), c("match_count").alias("one_match_count"), c("iou").alias("one_iou"), (c("prediction_count") + c("page_idx") % 2).alias("two_prediction_count"),
        F.greatest(c("match_count") - c("page_idx") % 3, F.lit(0)).alias("two_match_count"), c("iou").alias("two_iou"), F.least(c("match_count"), F.lit(1)).alias("both_match_count"), c("iou").alias("both_iou"),
    )
    return r.compare_systems(two, "family", "one", "two", "both")


_MISS, _EXTRA = "greatest(gt_count - match_count, 0)", "greatest(prediction_count - match_count, 0)"


@query(
    f"""{_PAGES_RESULT} SELECT page_idx, {_MISS} AS misses, {_EXTRA} AS extras, CASE WHEN p = '' THEN 'none' ELSE p END AS problems, problem_score FROM (SELECT *, concat_ws('|', CASE WHEN gt_count > 0 AND match_count = 0 THEN 'nothing matched' WHEN {_MISS} > 0 THEN 'missed' END, CASE WHEN gt_count > 1 AND {_MISS} > 0 THEN 'group incomplete' END, CASE WHEN {_EXTRA} > 0 THEN 'extra' END, CASE WHEN f1 > 0 AND f1 < 0.95 THEN 'low f1' END) AS p,
 {round_sql(f'CAST(CASE WHEN gt_count > 0 AND match_count = 0 THEN 100 ELSE 0 END + {_MISS} * 20 + CASE WHEN gt_count > 1 AND {_MISS} > 0 THEN 10 ELSE 0 END + {_EXTRA} * 8 AS DOUBLE) + greatest(0.0, 1 - f1)')} AS problem_score FROM res)"""
)
def page_problems(spark: SparkSession, d: str) -> DataFrame:
    return r.page_problems(LAYOUT["page_metrics"](spark, d))


_SORTED = """SELECT *, CASE WHEN vectors > 0 AND rasters > 0 THEN 'mixed_vector_raster' WHEN vectors > 0 THEN 'vector_dominant' WHEN rasters > 0 THEN CASE WHEN panels >= 2 OR figures >= 2 THEN 'compound_multi_panel' ELSE 'mixed_vector_raster' END ELSE 'unknown' END AS base,
 CASE WHEN vectors > 0 AND rasters > 0 THEN 0.65 WHEN vectors > 0 THEN 0.7 WHEN rasters > 0 THEN CASE WHEN panels >= 2 OR figures >= 2 THEN 0.65 ELSE 0.4 END WHEN figures > 0 THEN 0.25 ELSE 0.0 END AS sure, flow AND figures > 0 AS route FROM sig"""


@query(
    f"""{WITH_ATOMS}, seen AS (SELECT page_idx, count(*) FILTER (kind = 'vector_cluster') AS vectors, count(*) FILTER (kind = 'raster_image') AS rasters, count(*) AS elements, count(*) FILTER (kind = 'text_block' AND regexp_matches(text, '^ *(图|fig|Fig|FIG)')) AS captions, coalesce(bool_or(kind = 'text_block' AND text LIKE '%supplier%'), false) AS flow FROM atoms GROUP BY 1),
 figs AS (SELECT page_idx, count(*) AS figures, sum(ord % 3) AS panels FROM preds WHERE kind IN ('raster_image', 'panel_border') GROUP BY 1), sig AS (SELECT s.*, coalesce(figures, 0) AS figures, coalesce(panels, 0) AS panels FROM seen s LEFT JOIN figs USING (page_idx)), b AS ({_SORTED}), m AS (SELECT *, NOT route AND panels >= 3 AND base <> 'compound_multi_panel' AS many FROM b)
 SELECT page_idx, CASE WHEN figures = 0 THEN 'unknown' WHEN route THEN 'route_map_or_flow' WHEN many THEN 'compound_multi_panel' ELSE base END AS family, CASE WHEN elements > 80 OR panels >= 5 THEN 'stress' WHEN figures >= 2 OR (figures > 0 AND captions > 0 AND elements > 40) THEN 'hard' ELSE 'control' END AS difficulty,
 CAST(CASE WHEN figures = 0 THEN 0.3 WHEN route OR many THEN greatest(sure, 0.6) ELSE sure END AS DOUBLE) AS confidence,
 concat_ws(';', CASE WHEN vectors > 0 AND rasters > 0 THEN 'vector=' || vectors || ';raster=' || rasters WHEN vectors > 0 THEN 'vector_only=' || vectors WHEN rasters > 0 THEN CASE WHEN panels >= 2 OR figures >= 2 THEN 'raster_multi_panel=' || panels || ';figs=' || figures ELSE 'raster_single=' || rasters END WHEN figures > 0 THEN 'no_atom_kind_breakdown' END,
  CASE WHEN route THEN 'flow_keyword_detected' END, CASE WHEN many THEN 'high_panel_count=' || panels END, CASE WHEN figures = 0 THEN 'no_figures' WHEN figures >= 2 THEN 'multi_figure_page=' || figures WHEN captions > 0 AND elements > 40 THEN 'dense_page_with_caption;atoms=' || elements END, CASE WHEN elements > 80 THEN 'very_dense_page;atoms=' || elements END, CASE WHEN panels >= 5 THEN 'many_panels=' || panels END, CASE WHEN figures = 0 THEN 'page_has_no_figures' END) AS reasons FROM m"""
)
def page_sorting(spark: SparkSession, d: str) -> DataFrame:
    """First sorting of pages by family and difficulty from their elements and a system's figures."""
    a = stored_atoms(spark, d)
    figures = predictions(spark, d, a).where(F.col("kind").isin("raster_image", "panel_border")).select("page_idx", (F.col("ord") % 3).alias("panels"))
    signals = r.page_signals(a, figures, has_keyword(F.col("text"), ("supplier",)))
    return signals.select("page_idx", *[c.alias(n) for n, c in r.sort_page().items()])
