"""Queries over derived layouts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions import geometry as g
from pagefold.operators import groups, matching, pagegraph
from pagefold.operators.boxjoin import box_join, self_pairs
from pagefold.sources.layouts import ATOMS_SQL, HEIGHT, PAGES_SQL, PREDICTIONS_SQL, WIDTH, atoms, pages, predictions, stored_atoms
from pagefold.plans.shared import stored
from pagefold.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
BOX = ("page_idx", "ord", "x0", "y0", "x1", "y1")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL of the measures, on prefixes.
def area_sql(p: str) -> str:
    return f"(greatest({p}x1 - {p}x0, 0.0) * greatest({p}y1 - {p}y0, 0.0))"


def inter_sql(a: str, b: str) -> str:
    return f"(greatest(least({a}x1, {b}x1) - greatest({a}x0, {b}x0), 0.0) * greatest(least({a}y1, {b}y1) - greatest({a}y0, {b}y0), 0.0))"


def iou_sql(a: str, b: str) -> str:
    i = inter_sql(a, b)
    return f"(CASE WHEN {area_sql(a)} + {area_sql(b)} - {i} > 0 THEN {i} / ({area_sql(a)} + {area_sql(b)} - {i}) ELSE 0.0 END)"


def cover_sql(a: str, b: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN {inter_sql(a, b)} / {whole} ELSE 0.0 END)"


def gap_sql(a: str, b: str) -> str:
    dx, dy = (f"greatest(greatest({a}{c}0, {b}{c}0) - least({a}{c}1, {b}{c}1), 0.0)" for c in "xy")
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def round_sql(e: str, digits: int = 4) -> str:
    """Rounding half up of the number as it is written, which is what Spark's ``round`` does."""
    return f"CAST(round(CAST(CAST({e} AS VARCHAR) AS DECIMAL(30,18)), {digits}) AS DOUBLE)"


WITH_ATOMS = f"WITH atoms AS MATERIALIZED ({ATOMS_SQL}), preds AS MATERIALIZED ({PREDICTIONS_SQL}), pages AS MATERIALIZED ({PAGES_SQL})"


@query(f"{WITH_ATOMS} SELECT * FROM atoms")
def page_atoms(spark: SparkSession, d: str) -> DataFrame:
    return atoms(spark, d)


_r4 = lambda c: F.round(c, 4)


@query(
    f"""{WITH_ATOMS} SELECT page_idx, ord, {area_sql('')} AS area, round(greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0), 4) AS aspect,
 least(x1, 480.0) - least(x0, 480.0) AS clipped_width, greatest(least(y0, 640.0), least(y1, 640.0)) - least(y0, 640.0) AS clipped_height,
 CAST(x0 <= 12 AS INT) + CAST(y0 <= 12 AS INT) + CAST(x1 >= 480 - 12 AS INT) + CAST(y1 >= 640 - 12 AS INT) AS edges,
 greatest(x0 - 8, 0.0) AS pad_x0, least(y1 + 8, 760.0) AS pad_y1, round(x1 / 600 * 420, 4) AS scaled_x1, round(y1 / 760 * 320, 4) AS scaled_y1,
 round(least(greatest((x0 - 100) / 200, 0.0), 1.0), 4) AS ramp, round(CAST(ord AS DOUBLE) / (ord + 3), 4) AS soft FROM atoms"""
)
def box_scalars(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    clip, pad = g.clipped("", 480, 640), g.padded("", 8, WIDTH, HEIGHT)
    put = g.scaled("", F.lit(WIDTH), F.lit(HEIGHT), F.lit(420.0), F.lit(320.0))
    return a.select(
        "page_idx", "ord", g.area("").alias("area"), _r4(g.aspect("")).alias("aspect"), (clip[2] - clip[0]).alias("clipped_width"), (clip[3] - clip[1]).alias("clipped_height"),
        g.edges_touched("", 480, 640, 12).alias("edges"), pad[0].alias("pad_x0"), pad[3].alias("pad_y1"), put[2].alias("scaled_x1"), put[3].alias("scaled_y1"),
        _r4(g.saturation(F.col("x0"), 100, 300)).alias("ramp"), _r4(g.soft_count(F.col("ord").cast("double"), 3)).alias("soft"),
    )


# Ratios in whole millionths: engines round ties of binary fractions differently.
@query(
    f"""{WITH_ATOMS} SELECT a.page_idx, a.ord AS a_ord, b.ord AS b_ord, {inter_sql('a.', 'b.')} AS inter_area, floor({iou_sql('a.', 'b.')} * 1000000) AS iou_ppm,
 floor({cover_sql('a.', 'b.', area_sql('a.'))} * 1000000) AS cover_of_first_ppm, floor({cover_sql('a.', 'b.', f"least({area_sql('a.')}, {area_sql('b.')})")} * 1000000) AS cover_of_smaller_ppm, floor({gap_sql('a.', 'b.')} * 1000000) AS gap_millionths
 FROM atoms a JOIN atoms b ON a.page_idx = b.page_idx AND a.ord < b.ord WHERE {gap_sql('a.', 'b.')} <= 24"""
)
def box_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = self_pairs(stored_atoms(spark, d).select(*BOX), reach=24.0, where=g.gap("a_", "b_") <= 24)
    ppm = lambda c: F.floor(c * 1000000).cast("double")
    return pairs.select("page_idx", "a_ord", "b_ord", g.inter_area("a_", "b_").alias("inter_area"), ppm(g.iou("a_", "b_")).alias("iou_ppm"), ppm(g.cover_of_first("a_", "b_")).alias("cover_of_first_ppm"), ppm(g.cover_of_smaller("a_", "b_")).alias("cover_of_smaller_ppm"), ppm(g.gap("a_", "b_")).alias("gap_millionths"))


# Greedy matching as four unrolled rounds of mutual best choice; a test asserts that no pair is left after them.
def _match_sql(rounds: int = 4) -> str:
    parts = [f"pairs AS MATERIALIZED (SELECT a.page_idx, a.ord AS gt, b.ord AS pred, {iou_sql('a.', 'b.')} AS iou FROM atoms a JOIN preds b USING (page_idx) WHERE {iou_sql('a.', 'b.')} >= 0.5)", "r0 AS (SELECT * FROM pairs)"]
    for i in range(rounds):
        parts.append(f"k{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_idx, gt ORDER BY iou DESC, gt, pred) AS g, row_number() OVER (PARTITION BY page_idx, pred ORDER BY iou DESC, gt, pred) AS p FROM r{i})")
        parts.append(f"m{i} AS MATERIALIZED (SELECT page_idx, gt, pred, iou FROM k{i} WHERE g = 1 AND p = 1)")
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT r.* FROM r{i} r WHERE NOT EXISTS (SELECT 1 FROM m{i} m WHERE m.page_idx = r.page_idx AND (m.gt = r.gt OR m.pred = r.pred)))")
    union = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(rounds))
    return ", ".join([*parts, f"matches AS MATERIALIZED ({union})"])


_F1 = "CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END"
_PAGES_RESULT = f"""{WITH_ATOMS}, {_match_sql()}, ct AS (SELECT page_idx, count(*) AS n FROM atoms GROUP BY 1), cp AS (SELECT page_idx, count(*) AS n FROM preds GROUP BY 1),
 cm AS (SELECT page_idx, count(*) AS n, sum(CAST({round_sql('iou')} AS DECIMAL(12,4))) AS s FROM matches GROUP BY 1),
 res0 AS (SELECT s.*, coalesce(ct.n, 0) AS gt_count, coalesce(cp.n, 0) AS prediction_count, coalesce(cm.n, 0) AS match_count, CAST(cm.s * 10000 AS BIGINT) AS si FROM pages s LEFT JOIN ct USING (page_idx) LEFT JOIN cp USING (page_idx) LEFT JOIN cm USING (page_idx)),
 res1 AS (SELECT *, CASE WHEN prediction_count > 0 THEN match_count / prediction_count ELSE 0.0 END AS p, CASE WHEN gt_count > 0 THEN match_count / gt_count ELSE 0.0 END AS r FROM res0),
 res AS (SELECT page_idx, doc_id, family, difficulty, gt_count, prediction_count, match_count, {round_sql('p')} AS precision, {round_sql('r')} AS recall, {round_sql('(' + _F1 + ')')} AS f1, CASE WHEN match_count > 0 THEN ((2 * si + match_count) // (2 * match_count)) / 10000 ELSE 0.0 END AS iou FROM res1)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    truth = stored_atoms(spark, d)
    found = predictions(spark, d, truth)
    return matching.page_counts(pages(spark, d), truth, found, matching.greedy_match(matching.scored_pairs(truth, found)))


@query(f"{_PAGES_RESULT} SELECT * FROM res")
def page_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d)


def _micro_sql(keys: str, group: str) -> str:
    return f"""SELECT {keys}page_count, total_gt_count, total_prediction_count, total_match_count, {round_sql('p')} AS precision, {round_sql('r')} AS recall, {round_sql('(' + _F1 + ')')} AS f1, CASE WHEN total_match_count > 0 THEN ((2 * CAST(w * 10000 AS BIGINT) + total_match_count) // (2 * total_match_count)) / 10000 ELSE 0.0 END AS iou FROM (
 SELECT *, CASE WHEN total_prediction_count > 0 THEN total_match_count / total_prediction_count ELSE 0.0 END AS p, CASE WHEN total_gt_count > 0 THEN total_match_count / total_gt_count ELSE 0.0 END AS r FROM (
 SELECT {keys}count(*) AS page_count, coalesce(sum(gt_count), 0) AS total_gt_count, coalesce(sum(prediction_count), 0) AS total_prediction_count, coalesce(sum(match_count), 0) AS total_match_count, sum(CAST(iou AS DECIMAL(12,4)) * match_count) AS w FROM res {group}))"""


@query(f"{_PAGES_RESULT} {_micro_sql('', '')}")
def micro_metrics(spark: SparkSession, d: str) -> DataFrame:
    return matching.micro(_results(spark, d))


@query(f"{_PAGES_RESULT} {_micro_sql('family, difficulty, ', 'GROUP BY GROUPING SETS ((family), (difficulty), ())')}")
def group_metrics(spark: SparkSession, d: str) -> DataFrame:
    return matching.grouped_micro(_results(spark, d), "family", "difficulty")


_SIDES = {"left": ("p_x0 - g_x0", "gw"), "top": ("p_y0 - g_y0", "gh"), "right": ("g_x1 - p_x1", "gw"), "bottom": ("g_y1 - p_y1", "gh")}
_ERRORS = [(f"crop_{s}", f"greatest({e}, 0.0) / {m}") for s, (e, m) in _SIDES.items()] + [(f"over_{s}", f"greatest(-({e}), 0.0) / {m}") for s, (e, m) in _SIDES.items()]
_FLAG_TESTS = [("fp", "status = 'FP'"), ("low_iou_match", "status = 'MATCH' AND iou < 0.75"), ("low_pred_purity", "purity < 0.85"), ("low_gt_coverage", "status = 'MATCH' AND coverage < 0.9"), *[(n, f"{area_sql('g_')} > 0 AND {e} > 0.1") for n, e in _ERRORS], ("oversized_box", "area_ratio > 1.8"), ("inside_gt_fragment_or_legend", "coverage < 0.65 AND purity > 0.9")]
_STRICT = f"""{WITH_ATOMS}, {_match_sql()},
 hit AS MATERIALIZED (SELECT m.page_idx, 'MATCH' AS status, m.gt, m.pred, p.x0 AS p_x0, p.y0 AS p_y0, p.x1 AS p_x1, p.y1 AS p_y1, t.x0 AS g_x0, t.y0 AS g_y0, t.x1 AS g_x1, t.y1 AS g_y1 FROM matches m JOIN atoms t ON t.page_idx = m.page_idx AND t.ord = m.gt JOIN preds p ON p.page_idx = m.page_idx AND p.ord = m.pred),
 lone AS MATERIALIZED (SELECT p.* FROM preds p WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page_idx = p.page_idx AND m.pred = p.ord)),
 near AS MATERIALIZED (SELECT * FROM (SELECT p.page_idx, p.ord AS pred, t.x0 AS g_x0, t.y0 AS g_y0, t.x1 AS g_x1, t.y1 AS g_y1, row_number() OVER (PARTITION BY p.page_idx, p.ord ORDER BY {iou_sql('p.', 't.')} DESC, t.ord) AS n FROM lone p JOIN atoms t USING (page_idx) WHERE {inter_sql('p.', 't.')} > 0) WHERE n = 1),
 fps AS (SELECT p.page_idx, 'FP' AS status, CAST(NULL AS INTEGER) AS gt, p.ord AS pred, p.x0 AS p_x0, p.y0 AS p_y0, p.x1 AS p_x1, p.y1 AS p_y1, coalesce(n.g_x0, 0.0) AS g_x0, coalesce(n.g_y0, 0.0) AS g_y0, coalesce(n.g_x1, 0.0) AS g_x1, coalesce(n.g_y1, 0.0) AS g_y1 FROM lone p LEFT JOIN near n ON n.page_idx = p.page_idx AND n.pred = p.ord),
 measured AS (SELECT *, {iou_sql('p_', 'g_')} AS iou, {cover_sql('p_', 'g_', area_sql('p_'))} AS purity, {cover_sql('g_', 'p_', area_sql('g_'))} AS coverage, CASE WHEN {area_sql('g_')} > 0 THEN {area_sql('p_')} / {area_sql('g_')} ELSE 0.0 END AS area_ratio, greatest(g_x1 - g_x0, 1.0) AS gw, greatest(g_y1 - g_y0, 1.0) AS gh FROM (SELECT * FROM hit UNION ALL SELECT * FROM fps)),
 strict AS (SELECT page_idx, status, gt, pred, {round_sql('iou')} AS iou, {round_sql('purity')} AS purity, {round_sql('coverage')} AS coverage, {round_sql('area_ratio')} AS area_ratio, concat_ws('|', {', '.join(f"CASE WHEN {t} THEN '{n}' END" for n, t in _FLAG_TESTS)}) AS flags FROM measured
 UNION ALL SELECT t.page_idx, 'MISS', t.ord, NULL, 0.0, 0.0, 0.0, 0.0, 'miss' FROM atoms t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page_idx = t.page_idx AND m.gt = t.ord))"""


def _strict(spark: SparkSession, d: str) -> DataFrame:
    truth = stored_atoms(spark, d)
    found = predictions(spark, d, truth)
    return matching.strict_rows(truth, found, matching.greedy_match(matching.scored_pairs(truth, found)))


@query(f"{_STRICT} SELECT * FROM strict")
def strict_quality(spark: SparkSession, d: str) -> DataFrame:
    return _strict(spark, d)


@query(f"{_STRICT} SELECT status, flag, count(*) AS n FROM (SELECT status, unnest(string_split(flags, '|')) AS flag FROM strict) WHERE flag <> '' GROUP BY 1, 2")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return _strict(spark, d).select("status", F.explode(F.split("flags", r"\|")).alias("flag")).where("flag <> ''").groupBy("status", "flag").agg(F.count(F.lit(1)).alias("n"))


_STRUCT_T = "SELECT page_idx, ord, CAST(xref % 3 AS VARCHAR) AS group_id, xref % 4 AS panels, x0, y0, x1, y1 FROM atoms"
_STRUCT_F = "SELECT p.page_idx, p.ord, CASE WHEN a.xref % 5 = 0 THEN [CAST(a.xref % 3 AS VARCHAR), CAST((a.xref + 1) % 3 AS VARCHAR)] ELSE [CAST(a.xref % 3 AS VARCHAR)] END AS group_ids, a.xref % 3 AS panels, CAST(a.xref * 10 AS DOUBLE) AS excluded, p.x0, p.y0, p.x1, p.y1 FROM preds p JOIN atoms a ON a.page_idx = p.page_idx AND a.ord = p.ord"


@query(
    f"""{WITH_ATOMS}, t AS ({_STRUCT_T}), f AS ({_STRUCT_F}), held AS (SELECT page_idx, unnest(group_ids) AS group_id, panels, ord, x0, y0, x1, y1 FROM f),
 many AS (SELECT page_idx, group_id, count(*) AS n FROM held GROUP BY 1, 2), firsts AS (SELECT page_idx, group_ids[1] AS group_id, count(*) AS n FROM f GROUP BY 1, 2),
 x AS (SELECT t.page_idx, count(*) AS gt_count, sum(greatest(coalesce(n, 0) - 1, 0)) AS extra FROM t LEFT JOIN many USING (page_idx, group_id) GROUP BY 1),
 o AS (SELECT page_idx, sum(greatest(coalesce(n, 0) - 1, 0)) AS once FROM (SELECT DISTINCT page_idx, group_id FROM t) LEFT JOIN firsts USING (page_idx, group_id) GROUP BY 1),
 best AS (SELECT * FROM (SELECT t.page_idx, t.ord, t.panels AS want, h.panels AS have, row_number() OVER (PARTITION BY t.page_idx, t.ord ORDER BY {iou_sql('t.', 'h.')} DESC, h.ord) AS n FROM t JOIN held h USING (page_idx, group_id)) WHERE n = 1),
 c AS (SELECT page_idx, sum(CAST(CASE WHEN want = 0 THEN 1.0 ELSE round(least(want, have) / want, 4) END AS DECIMAL(12,4))) AS parts FROM best GROUP BY 1),
 q AS (SELECT page_idx, count(*) AS prediction_count, sum(CAST(len(group_ids) > 1 AS INT)) AS merged, sum(CAST(CASE WHEN {area_sql('')} > 0 THEN {round_sql('excluded / ' + area_sql(''))} ELSE 0.0 END AS DECIMAL(14,4))) AS dirty FROM f GROUP BY 1)
 SELECT s.page_idx, coalesce(gt_count, 0) AS gt_count, coalesce(prediction_count, 0) AS prediction_count, CASE WHEN gt_count > 0 THEN {round_sql('extra / gt_count')} ELSE 0.0 END AS fragmentation, CASE WHEN gt_count > 0 THEN {round_sql('once / gt_count')} ELSE 0.0 END AS fragmentation_distinct,
 CASE WHEN prediction_count > 0 THEN {round_sql('merged / prediction_count')} ELSE 0.0 END AS overmerge, CASE WHEN prediction_count > 0 THEN ((2 * CAST(dirty * 10000 AS BIGINT) + prediction_count) // (2 * prediction_count)) / 10000 ELSE 0.0 END AS contamination, CASE WHEN gt_count > 0 THEN ((2 * CAST(coalesce(parts, 0) * 10000 AS BIGINT) + gt_count) // (2 * gt_count)) / 10000 ELSE 0.0 END AS completeness
 FROM pages s LEFT JOIN x USING (page_idx) LEFT JOIN o USING (page_idx) LEFT JOIN c USING (page_idx) LEFT JOIN q USING (page_idx)"""
)
def page_structure(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    text = lambda c: (c % 3).cast("string")
    x = F.col("xref")
    truth = a.select("page_idx", "ord", text(x).alias("group_id"), (x % 4).alias("panels"), "x0", "y0", "x1", "y1")
    extra = a.select("page_idx", "ord", F.when(x % 5 == 0, F.array(text(x), text(x + 1))).otherwise(F.array(text(x))).alias("group_ids"), (x % 3).alias("panels"), (x * 10).cast("double").alias("excluded"))
    found = predictions(spark, d).drop("kind").join(extra, ["page_idx", "ord"])
    return matching.structure(truth, found, pages(spark, d))


@query(f"{WITH_ATOMS} SELECT o.page_idx, o.ord AS source, i.ord AS target FROM atoms o JOIN atoms i ON o.page_idx = i.page_idx AND o.ord <> i.ord WHERE o.kind IN ('panel_border', 'vector_cluster') AND i.x0 >= o.x0 - 2 AND i.y0 >= o.y0 - 2 AND i.x1 <= o.x1 + 2 AND i.y1 <= o.y1 + 2")
def containment(spark: SparkSession, d: str) -> DataFrame:
    a = stored_atoms(spark, d)
    return pagegraph.contained(a.where(F.col("kind").isin("panel_border", "vector_cluster")).select(*BOX), a.select(*BOX))


_NUMBER_SQL = r"nullif(regexp_extract(text, '(?i)^\s*(?:fig(?:ure)?\.?|图|圖)\s*(\d+(?:\.\d+)*(?:-\d+)?[A-Za-z]?)(?:\s|[:：.。)、\]-]|$)', 1), '')"


@query(
    f"""{WITH_ATOMS}, mk AS (SELECT *, {_NUMBER_SQL} AS number FROM atoms WHERE kind = 'text_block'),
 c AS (SELECT i.page_idx, i.ord, m.number, greatest(m.y0 - i.y1, 0.0) AS dist, least(i.x1, m.x1) - greatest(i.x0, m.x0) AS over FROM atoms i JOIN mk m USING (page_idx) WHERE i.kind = 'raster_image' AND m.number IS NOT NULL
  AND (least(i.x1, m.x1) - greatest(i.x0, m.x0)) / greatest(least(i.x1 - i.x0, m.x1 - m.x0), 1.0) >= 0.2 AND m.y0 >= i.y0 - greatest(16.0, (i.y1 - i.y0) * 0.25) AND greatest(m.y0 - i.y1, 0.0) <= greatest(96.0, 760 * 0.33))
 SELECT page_idx, ord, number FROM (SELECT *, row_number() OVER (PARTITION BY page_idx, ord ORDER BY dist, over DESC, number) AS n FROM c) WHERE n = 1"""
)
def caption_numbers(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.functions.text import leading_figure_number

    a = stored_atoms(spark, d)
    markers = a.where("kind = 'text_block'").withColumn("number", leading_figure_number(F.col("text"))).where("number IS NOT NULL").select(*BOX, "number")
    return pagegraph.nearest_caption(a.where("kind = 'raster_image'").select(*BOX), markers, HEIGHT)


_BARRIER = """(least({a}x1, {b}x1) > greatest({a}x0, {b}x0) AND greatest({a}y0, {b}y0) > CASE WHEN {a}y0 <= {b}y0 THEN {a}y1 ELSE {b}y1 END
  AND t.y1 > CASE WHEN {a}y0 <= {b}y0 THEN {a}y1 ELSE {b}y1 END AND t.y0 < greatest({a}y0, {b}y0)
  AND (least(least({a}x1, {b}x1), t.x1) - greatest(greatest({a}x0, {b}x0), t.x0)) / (least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) >= 0.8)
 OR (least({a}y1, {b}y1) > greatest({a}y0, {b}y0) AND greatest({a}x0, {b}x0) > CASE WHEN {a}x0 <= {b}x0 THEN {a}x1 ELSE {b}x1 END
  AND t.x1 > CASE WHEN {a}x0 <= {b}x0 THEN {a}x1 ELSE {b}x1 END AND t.x0 < greatest({a}x0, {b}x0)
  AND (least(least({a}y1, {b}y1), t.y1) - greatest(greatest({a}y0, {b}y0), t.y0)) / (least({a}y1, {b}y1) - greatest({a}y0, {b}y0)) >= 0.6)"""


def _gap_between(lo: str, hi: str) -> str:
    return f"({hi} - {lo}) BETWEEN 0 AND "


_OX, _OY = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))", "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_WIDE, _TALL = f"{_OX} > 0 AND {_OX} / greatest(a.x1 - a.x0, 1.0) >= 0.5", f"{_OY} > 0 AND {_OY} / greatest(a.y1 - a.y0, 1.0) >= 0.5"
_FITS = "b.x1 - b.x0 <= 2.5 * greatest(a.x1 - a.x0, 1.0) AND b.y1 - b.y0 <= {} * greatest(a.y1 - a.y0, 1.0)"
_SIDE = f"""CASE WHEN {_WIDE} AND b.y0 - a.y1 BETWEEN 0 AND 40 THEN CASE WHEN {_FITS.format(1.5)} THEN 'bottom' END WHEN {_WIDE} AND a.y0 - b.y1 BETWEEN 0 AND 40 THEN CASE WHEN {_FITS.format(1.5)} THEN 'top' END
 WHEN {_TALL} AND b.x0 - a.x1 BETWEEN 0 AND 40 THEN CASE WHEN {_FITS.format(1.75)} THEN 'right' END WHEN {_TALL} AND a.x0 - b.x1 BETWEEN 0 AND 40 THEN CASE WHEN {_FITS.format(1.75)} THEN 'left' END END"""
_GRAPH = f"""{WITH_ATOMS}, panels AS (SELECT * FROM atoms WHERE kind IN ('panel_border', 'raster_image')), caps AS (SELECT * FROM atoms WHERE kind = 'text_block' AND text LIKE 'Figure %'),
 plain AS (SELECT a.* FROM atoms a WHERE NOT EXISTS (SELECT 1 FROM caps c WHERE c.page_idx = a.page_idx AND c.ord = a.ord)),
 holds AS (SELECT a.page_idx, a.ord AS source, b.ord AS target FROM panels a JOIN plain b ON a.page_idx = b.page_idx AND a.ord <> b.ord WHERE b.x0 >= a.x0 - 2 AND b.y0 >= a.y0 - 2 AND b.x1 <= a.x1 + 2 AND b.y1 <= a.y1 + 2),
 free AS (SELECT a.* FROM plain a WHERE NOT EXISTS (SELECT 1 FROM holds h WHERE h.page_idx = a.page_idx AND h.target = a.ord)),
 lines AS (SELECT a.page_idx, a.ord AS source, b.ord AS target, {_OY} > 0 AND {_OY} / greatest(least(a.y1 - a.y0, b.y1 - b.y0), 1.0) >= 0.4 AS in_row, {_OX} > 0 AND {_OX} / greatest(least(a.x1 - a.x0, b.x1 - b.x0), 1.0) >= 0.4 AS in_column
  FROM panels a JOIN panels b ON a.page_idx = b.page_idx AND (a.y0, a.x0, a.ord) < (b.y0, b.x0, b.ord) WHERE {inter_sql('a.', 'b.')} / least({area_sql('a.')}, {area_sql('b.')}) < 0.8
  AND NOT EXISTS (SELECT 1 FROM atoms t WHERE t.page_idx = a.page_idx AND t.kind = 'text_block' AND ({_BARRIER.format(a='a.', b='b.')}))),
 edges AS (SELECT page_idx, source, target, 'contains' AS relation FROM holds
 UNION ALL SELECT a.page_idx, a.ord, b.ord, 'caption_of' FROM panels a JOIN caps b USING (page_idx) WHERE {_OX} > 0 AND b.y0 - a.y1 BETWEEN 0 AND 80 AND {_OX} / greatest(least(greatest(a.x1 - a.x0, 1.0), greatest(b.x1 - b.x0, 1.0)), 1.0) >= 0.35
 UNION ALL SELECT page_idx, source, target, 'same_row' FROM lines WHERE in_row UNION ALL SELECT page_idx, source, target, 'same_column' FROM lines WHERE in_column
 UNION ALL SELECT a.page_idx, a.ord, b.ord, 'near_body_text' FROM panels a JOIN free b ON a.page_idx = b.page_idx AND b.kind = 'text_block' WHERE {_OX} > 0 AND (b.y0 - a.y1 BETWEEN 0 AND 80 OR a.y0 - b.y1 BETWEEN 0 AND 80)
 UNION ALL SELECT a.page_idx, a.ord, b.ord, 'attachment_candidate' FROM panels a JOIN free b ON a.page_idx = b.page_idx AND a.ord <> b.ord AND b.kind IN ('color_band', 'vector_cluster', 'raster_image') WHERE {_SIDE} IS NOT NULL)"""


def _graph(spark: SparkSession, d: str, a: DataFrame | None = None) -> DataFrame:
    a = stored_atoms(spark, d) if a is None else a
    return pagegraph.page_graph(a, a.where(F.col("kind").isin("panel_border", "raster_image")), a.where("kind = 'text_block' AND text LIKE 'Figure %'"))


@query(f"{_GRAPH} SELECT *, CASE WHEN relation = 'near_body_text' THEN 'repel' ELSE 'attract' END AS polarity FROM edges")
def page_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return pagegraph.bipolar(_graph(spark, d))


@query(
    f"""WITH RECURSIVE {_GRAPH[5:]}, steps AS MATERIALIZED (SELECT page_idx, source, target, bool_or(relation <> 'caption_of') AS content FROM edges e WHERE relation <> 'near_body_text' AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.relation = 'near_body_text' AND r.page_idx = e.page_idx AND r.source = e.source AND r.target = e.target) GROUP BY 1, 2, 3),
 walk AS (SELECT s.page_idx, p.ord AS seed, s.target AS node FROM panels p JOIN steps s ON s.page_idx = p.page_idx AND s.source = p.ord UNION SELECT w.page_idx, w.seed, s.target FROM walk w JOIN steps s ON s.page_idx = w.page_idx AND s.source = w.node)
 SELECT w.page_idx, w.seed, w.node, bool_or(s.content) AS content FROM walk w JOIN steps s ON s.page_idx = w.page_idx AND s.target = w.node AND (s.source = w.seed OR EXISTS (SELECT 1 FROM walk x WHERE x.page_idx = w.page_idx AND x.seed = w.seed AND x.node = s.source)) GROUP BY 1, 2, 3"""
)
def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    a = stored_atoms(spark, d)
    seeds = a.where(F.col("kind").isin("panel_border", "raster_image")).select("page_idx", "ord")
    return pagegraph.closure(seeds, pagegraph.bipolar(_graph(spark, d, a)))


_CLUSTERS = f"""WITH RECURSIVE {WITH_ATOMS[5:]}, v AS (SELECT * FROM atoms WHERE kind IN ('raster_image', 'vector_cluster')),
 links AS (SELECT a.page_idx, a.ord AS a, b.ord AS b FROM v a JOIN v b ON a.page_idx = b.page_idx AND a.ord <> b.ord WHERE {gap_sql('a.', 'b.')} <= 60 AND NOT EXISTS (SELECT 1 FROM atoms t WHERE t.page_idx = a.page_idx AND t.kind = 'text_block' AND ({_BARRIER.format(a='a.', b='b.')}))),
 walk AS (SELECT page_idx, ord, ord AS c FROM v UNION SELECT w.page_idx, w.ord, l.b FROM walk w JOIN links l ON l.page_idx = w.page_idx AND l.a = w.c),
 member AS (SELECT page_idx, ord, min(c) AS cluster FROM walk GROUP BY 1, 2)"""


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = stored_atoms(spark, d)
    v = a.where(F.col("kind").isin("raster_image", "vector_cluster"))
    return v, groups.page_clusters(v, 60.0, a.where("kind = 'text_block'"))


@query(f"{_CLUSTERS} SELECT * FROM member")
def visual_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)[1]


@query(f"{_CLUSTERS} SELECT m.page_idx, m.cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS members, count(*) FILTER (kind = 'raster_image') AS rasters, count(*) FILTER (kind = 'vector_cluster') AS vectors FROM member m JOIN v USING (page_idx, ord) GROUP BY 1, 2 HAVING count(*) >= 2")
def compact_groups(spark: SparkSession, d: str) -> DataFrame:
    v, member = _clusters(spark, d)
    return groups.union_boxes(v.join(member, ["page_idx", "ord"]), "page_idx", "cluster").where("members >= 2")


@query(f"{WITH_ATOMS} SELECT a.page_idx, a.ord, a.x0, a.y0, a.x1, a.y1 FROM atoms a WHERE kind = 'vector_cluster' AND NOT EXISTS (SELECT 1 FROM atoms b WHERE b.page_idx = a.page_idx AND b.ord <> a.ord AND b.kind IN ('raster_image', 'vector_cluster') AND {gap_sql('a.', 'b.')} <= 40)")
def isolated_visuals(spark: SparkSession, d: str) -> DataFrame:
    a = stored_atoms(spark, d)
    return groups.isolated(a.where("kind = 'vector_cluster'"), a.where(F.col("kind").isin("raster_image", "vector_cluster")), 40.0)


def suppress_sql(source: str, order: str, max_iou: float, max_cover: float, rounds: int) -> str:
    """CTEs up to ``settled(page_idx, ord, .., kept)``: suppression over ``source`` as so many unrolled rounds; a test asserts that none is missing."""
    near = f"({iou_sql('a.', 'b.')} > {max_iou} OR {inter_sql('a.', 'b.')} / least({area_sql('a.')}, {area_sql('b.')}) > {max_cover})"
    parts = [f"placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_idx ORDER BY {order}) AS place FROM {source})", f"v0 AS MATERIALIZED (SELECT a.page_idx, a.ord AS better, b.ord AS worse FROM placed a JOIN placed b ON a.page_idx = b.page_idx AND a.place < b.place AND {near})"]
    for i in range(rounds):
        parts.append(f"o{i} AS MATERIALIZED (SELECT DISTINCT page_idx, worse AS ord FROM v{i} r WHERE NOT EXISTS (SELECT 1 FROM v{i} x WHERE x.page_idx = r.page_idx AND x.worse = r.better))")
        parts.append(f"v{i + 1} AS MATERIALIZED (SELECT * FROM v{i} r WHERE NOT EXISTS (SELECT 1 FROM o{i} o WHERE o.page_idx = r.page_idx AND o.ord IN (r.better, r.worse)))")
    gone = " UNION ALL ".join(f"SELECT * FROM o{i}" for i in range(rounds))
    return ", ".join([*parts, f"settled AS (SELECT p.*, g.ord IS NULL AS kept FROM placed p LEFT JOIN ({gone}) g USING (page_idx, ord))"])


_BOTH = "SELECT page_idx, ord, x0, y0, x1, y1, xref FROM atoms UNION ALL SELECT page_idx, ord + 1000, x0, y0, x1, y1, ord % 5 FROM preds"


@query(f"{WITH_ATOMS}, both_ AS ({_BOTH}), {suppress_sql('both_', 'xref DESC, ord', 0.8, 0.9, 6)} SELECT page_idx, ord, x0, y0, x1, y1, xref, kept FROM settled")
def suppressed_boxes(spark: SparkSession, d: str) -> DataFrame:
    a = stored_atoms(spark, d)
    both = a.select(*BOX, "xref").unionByName(predictions(spark, d, a).select("page_idx", (F.col("ord") + 1000).alias("ord"), "x0", "y0", "x1", "y1", (F.col("ord") % 5).cast("bigint").alias("xref")))
    return groups.suppress(both, [F.col("xref").desc(), F.col("ord").asc()])


@query(f"{WITH_ATOMS} SELECT page_idx, ord AS id, kind AS strategy, round(xref / 97.0, 6) AS score, proposals FROM (SELECT *, row_number() OVER (PARTITION BY page_idx ORDER BY xref % 4 <> 0 DESC, round(xref / 97.0, 6) DESC, (y0 % 7) DESC, kind DESC, ord DESC) AS n, count(*) OVER (PARTITION BY page_idx) AS proposals FROM atoms) WHERE n = 1")
def boundary_winners(spark: SparkSession, d: str) -> DataFrame:
    p = atoms(spark, d).select("page_idx", F.col("ord").alias("id"), F.col("kind").alias("strategy"), F.round(F.col("xref") / 97.0, 6).alias("score"), (F.col("y0") % 7).alias("priority"), (F.col("xref") % 4 != 0).alias("eligible"))
    return groups.arbitrate(p, ["page_idx"]).select("page_idx", "id", "strategy", "score", "proposals")


@query(f"{WITH_ATOMS} SELECT page_idx, ord, x0, x1, 1 + sum(cut) OVER (PARTITION BY page_idx ORDER BY x0, ord ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN x0 > 18 + max(x1) OVER (PARTITION BY page_idx ORDER BY x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS cut FROM atoms)")
def strip_runs(spark: SparkSession, d: str) -> DataFrame:
    return groups.strips(atoms(spark, d), 18.0).select("page_idx", "ord", "x0", "x1", "run")


@query(f"{WITH_ATOMS} SELECT page_idx, kind, ord, xref FROM (SELECT *, row_number() OVER (PARTITION BY page_idx, kind ORDER BY xref, ord) AS n FROM atoms) WHERE n = 1")
def first_per_kind(spark: SparkSession, d: str) -> DataFrame:
    return groups.first_of(atoms(spark, d), ["page_idx", "kind"], ["xref", "ord"]).select("page_idx", "kind", "ord", "xref")


@query(f"{WITH_ATOMS} SELECT xref, count(DISTINCT page_idx) AS pages, count(*) AS uses FROM atoms WHERE kind = 'raster_image' GROUP BY 1")
def xref_usage(spark: SparkSession, d: str) -> DataFrame:
    return atoms(spark, d).where("kind = 'raster_image'").groupBy("xref").agg(F.countDistinct("page_idx").alias("pages"), F.count(F.lit(1)).alias("uses"))


_PLACE = "concat_ws(',', " + ", ".join(f"printf('%.3f', round({c} / {m}, 3))" for c, m in (("x0", 600), ("y0", 760), ("x1", 600), ("y1", 760))) + ")"


@query(
    f"""{WITH_ATOMS}, snapped AS MATERIALIZED (SELECT page_idx, ord, kind, text, xref, x0 - x0 % 100 AS x0, y0 - y0 % 100 AS y0, x0 - x0 % 100 + 180 AS x1, y0 - y0 % 100 + 90 AS y1 FROM atoms), texts AS MATERIALIZED (SELECT *, (x1 - x0) / 600 >= 0.3 AND length(text) >= 20 AS body FROM snapped WHERE kind = 'text_block' AND length(text) >= 12), over_ AS (SELECT page_idx, bool_or(body) AS bodies FROM texts GROUP BY 1),
 k AS (SELECT a.page_idx, a.ord, a.kind, p.doc_id, {_PLACE} || CASE WHEN kind = 'vector_cluster' THEN '|' || (xref % 2) ELSE '' END AS spot, (a.x0 <= 300 AND a.x1 >= 300 AND a.y0 <= 380 AND a.y1 >= 380)
  OR EXISTS (SELECT 1 FROM texts t JOIN over_ o USING (page_idx) WHERE t.page_idx = a.page_idx AND (t.body OR NOT o.bodies) AND {inter_sql('a.', 't.')} / {area_sql('a.')} >= 0.08) AS over_text FROM snapped a JOIN pages p USING (page_idx) WHERE kind IN ('raster_image', 'vector_cluster')),
 n AS (SELECT doc_id, least(5, greatest(3, ceil(count(*) * 0.3))) AS least_n FROM pages GROUP BY 1),
 often AS (SELECT doc_id, kind, spot FROM k JOIN n USING (doc_id) GROUP BY doc_id, kind, spot, least_n HAVING count(*) >= least_n AND (kind <> 'vector_cluster' OR count(*) FILTER (over_text) / count(*) >= 0.6))
 SELECT page_idx, ord, kind, doc_id FROM k JOIN often USING (doc_id, kind, spot)"""
)
def template_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Elements that repeat at one place over a document's pages, places as they are after elements were snapped to a grid."""
    x, y = F.col("x0") - F.col("x0") % 100, F.col("y0") - F.col("y0") % 100
    a = stored(atoms(spark, d).select("page_idx", "ord", "kind", "text", "xref", x.alias("x0"), y.alias("y0"), (x + 180).alias("x1"), (y + 90).alias("y1")))
    texts = a.where("kind = 'text_block' AND length(text) >= 12").withColumn("body", (g.width("") / WIDTH >= 0.3) & (F.length("text") >= 20))
    visuals = a.where(F.col("kind").isin("raster_image", "vector_cluster"))
    over = groups.over_text(visuals, texts, WIDTH, HEIGHT)
    style = F.when(F.col("kind") == "vector_cluster", F.concat(F.lit("|"), (F.col("xref") % 2).cast("string"))).otherwise(F.lit(""))
    key = F.concat(g.normalised("", WIDTH, HEIGHT), style)
    return groups.repeated_templates(over, key, "doc_id", pages(spark, d)).select("page_idx", "ord", "kind", "doc_id")


_RECORDS = "SELECT page_idx, ord, x0, y0, x1, y1, 8 + xref % 5 AS font, xref % 4 = 0 AS single FROM atoms WHERE kind IN ('text_block', 'color_band')"


@query(
    f"""{WITH_ATOMS}, r AS ({_RECORDS}), w AS (SELECT * FROM r WHERE NOT single OR page_idx NOT IN (SELECT page_idx FROM r WHERE NOT single)),
 font AS (SELECT page_idx, font FROM (SELECT page_idx, font, row_number() OVER (PARTITION BY page_idx ORDER BY count(*) DESC, min(ord)) AS n FROM w GROUP BY 1, 2) WHERE n = 1),
 gaps AS (SELECT page_idx, median(gap) AS g FROM (SELECT page_idx, lead(y0) OVER (PARTITION BY page_idx ORDER BY y0, ord) - y1 AS gap FROM w) WHERE gap >= 0 GROUP BY 1)
 SELECT w.page_idx, any_value(f.font) AS body_font_size, max(x1 - x0) AS text_region_width, CASE WHEN count(DISTINCT round(x0, 1)) <= 1 THEN 1 ELSE 2 END AS text_region_columns, round(max(x1 - x0) / CASE WHEN count(DISTINCT round(x0, 1)) <= 1 THEN 1 ELSE 2 END, 4) AS column_width,
 CASE WHEN count(DISTINCT round(x0, 1)) > 1 THEN round(list_sort(list_distinct(list(round(x0, 1))))[2] - min(round(x0, 1)) - round(max(x1 - x0) / 2, 4), 4) ELSE 0.0 END AS column_gap, round(median(y1 - y0), 4) AS median_text_block_height, round(coalesce(any_value(g.g), 0.0), 4) AS median_paragraph_gap
 FROM w JOIN font f USING (page_idx) LEFT JOIN gaps g USING (page_idx) GROUP BY 1"""
)
def layout_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.operators.layout import fingerprints

    return fingerprints(_records(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return atoms(spark, d).where(F.col("kind").isin("text_block", "color_band")).select(*BOX, (F.col("xref") % 5 + 8).alias("font"), (F.col("xref") % 4 == 0).alias("single"))


@query(
    f"""SELECT page_idx, round(column_width * 0.3, 4) AS panel_border_min_size, round(column_width * 0.3, 4) AS color_band_min_width, round(body_font_size * 1.2, 4) AS color_band_min_height, round(column_width * 0.6, 4) AS image_seed_min_size, round(column_gap * 1.5, 4) AS cluster_max_gap, round(median_paragraph_gap * 3, 4) AS near_text_max_gap,
 round(median_paragraph_gap * 3, 4) AS near_body_text_max_gap, CAST(body_font_size * 4 AS DOUBLE) AS attachment_side_max_gap FROM ({SQL['layout_fingerprints']})"""
)
def layout_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds that follow each page's fingerprint, and the two that replace fixed ones."""
    from pagefold.operators.layout import fingerprints, relative_thresholds, visual_thresholds

    p = fingerprints(_records(spark, d))
    relative = relative_thresholds(F.col("column_width"), F.col("body_font_size"), F.col("column_gap"), F.col("median_paragraph_gap"))
    return p.select("page_idx", *[c.alias(n) for n, c in relative.items()], *[c.alias(n) for n, c in visual_thresholds(relative, F.col("body_font_size")).items()])


@query("SELECT event_type, count(*) AS count, round(sum(CAST(value AS DECIMAL(18,4))), 4) AS total, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS max, min(value) AS min FROM events GROUP BY 1")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.operators.reports import timing

    return timing(table(spark, d, "events"), "value", "event_type")


_RUNS = "SELECT page_idx, count(*) AS figures FROM atoms WHERE kind = 'raster_image' GROUP BY 1), b AS (SELECT page_idx, count(*) AS figures FROM preds WHERE kind IN ('raster_image', 'panel_border') GROUP BY 1"


@query(
    f"""{WITH_ATOMS}, a AS ({_RUNS}) SELECT coalesce(a.page_idx, b.page_idx) AS page_idx, coalesce(a.figures, 0) AS before, coalesce(b.figures, 0) AS after, coalesce(b.figures, 0) - coalesce(a.figures, 0) AS delta,
 CASE WHEN coalesce(a.figures, 0) = 0 AND coalesce(b.figures, 0) > 0 THEN 'gained' WHEN coalesce(a.figures, 0) > 0 AND coalesce(b.figures, 0) = 0 THEN 'lost' WHEN coalesce(a.figures, 0) > 0 THEN 'kept' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.page_idx = b.page_idx"""
)
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.operators.reports import compare_runs

    count = lambda t, kinds: t.where(F.col("kind").isin(*kinds)).groupBy("page_idx").agg(F.count(F.lit(1)).alias("figures"))
    return compare_runs(count(atoms(spark, d), ["raster_image"]), count(predictions(spark, d), ["raster_image", "panel_border"]))


_KEY = "family || '|' || difficulty || '|gt=' || gt_count || '|pred=' || prediction_count"


@query(f"{_PAGES_RESULT} SELECT {_KEY} AS cluster_key, count(*) AS page_count, max(gt_count) AS gt_count, min(page_idx) AS first_page, max(page_idx) AS last_page FROM res WHERE match_count < gt_count GROUP BY 1")
def error_clusters(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.operators.reports import cluster_errors

    return cluster_errors(_results(spark, d).where("match_count < gt_count"))


@query(f"{_PAGES_RESULT} SELECT {_KEY} AS cluster_key, page_idx, row_number() OVER (PARTITION BY {_KEY} ORDER BY page_idx) AS nth FROM res WHERE match_count < gt_count")
def error_cluster_pages(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.operators.reports import cluster_members

    return cluster_members(_results(spark, d).where("match_count < gt_count"))


@query(f"{WITH_ATOMS} SELECT page_idx, string_agg(CASE WHEN kind = 'raster_image' THEN '![](' || xref || '.png)' ELSE text END, E'\\n\\n' ORDER BY ord) AS markdown FROM atoms WHERE kind = 'raster_image' OR text <> '' GROUP BY 1")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.operators.repair import fold_markdown

    a = atoms(spark, d).select("page_idx", "ord", F.when(F.col("kind") == "raster_image", F.concat(F.lit("![]("), F.col("xref").cast("string"), F.lit(".png)"))).otherwise(F.col("text")).alias("md"))
    return fold_markdown(a, "page_idx", "ord", "md")


@query(
    f"""{WITH_ATOMS}, slots AS (SELECT *, row_number() OVER (PARTITION BY page_idx ORDER BY ord) AS ordinal FROM atoms WHERE kind = 'raster_image'), fresh AS (SELECT *, row_number() OVER (PARTITION BY page_idx ORDER BY ord) AS ordinal FROM preds WHERE kind = 'raster_image')
 SELECT s.page_idx, s.ord, s.ordinal, f.ord AS replacement, coalesce(f.x0, s.x0) AS x0, CASE WHEN f.ord IS NULL THEN 'keep_original' ELSE 'replace' END AS decision FROM slots s LEFT JOIN fresh f ON f.page_idx = s.page_idx AND f.ordinal = s.ordinal"""
)
def ordinal_repair(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.operators.repair import repair_by_ordinal

    raster = lambda t: t.where("kind = 'raster_image'").select(*BOX)
    return repair_by_ordinal(raster(atoms(spark, d)), raster(predictions(spark, d)))


def _provider(kind: str, where: str):
    from pagefold.sources.providers import PARSERS, payloads

    def run(spark: SparkSession, d: str) -> DataFrame:
        return PARSERS[kind](payloads(atoms(spark, d), kind), WIDTH, HEIGHT)

    QUERIES[f"provider_{kind}"] = run
    SQL[f"provider_{kind}"] = (
        f"{WITH_ATOMS} SELECT page_idx, row_number() OVER (PARTITION BY page_idx ORDER BY ord) AS figure, "
        + ", ".join(f"round({c} / {s} * {t}, 4) AS {c}" for c, s, t in (("x0", 1200, 600), ("y0", 1520, 760), ("x1", 1200, 600), ("y1", 1520, 760)))
        + f" FROM atoms WHERE {where}"
    )


for _kind in "abcd":
    _provider(_kind, "kind = 'raster_image'")

__all__ = ["QUERIES", "SQL", "box_join"]
