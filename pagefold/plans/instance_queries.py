"""Queries of raster groups, seeds without panels, object scores and duplicates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions.scores import points_box
from pagefold.operators import instances as n
from pagefold.operators.boxjoin import self_pairs
from pagefold.operators.panels import scope_numbers, text_roles
from pagefold.plans.layout_queries import WITH_ATOMS, area_sql, gap_sql, inter_sql, iou_sql, round_sql
from pagefold.plans.page_queries import _NUMBER, _flags_sql
from pagefold.sources.layouts import HEIGHT, WIDTH, predictions, stored_atoms

QUERIES: dict = {}
SQL: dict[str, str] = {}
BOX = ("x0", "y0", "x1", "y1")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query(f"{WITH_ATOMS} SELECT page_idx, 'figure_anchor_' || ord AS id, {_NUMBER} AS number, 0.95 AS confidence, x0, y0, x1, y1, x0 AS px0, y0 - 5 AS py0, x1 + 3 AS px1, y1 AS py1 FROM atoms WHERE kind = 'text_block' AND {_NUMBER} IS NOT NULL")
def figure_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Captions as anchors of figures, with the box of a few points around them."""
    roles = text_roles(stored_atoms(spark, d), WIDTH, HEIGHT).where("role = 'figure_caption'")
    points = F.array(F.struct(F.col("x0").alias("x"), F.col("y1").alias("y")), F.struct((F.col("x1") + 3).alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), (F.col("y0") - 5).alias("y")))
    return roles.select("page_idx", F.concat(F.lit("figure_anchor_"), F.col("ord").cast("string")).alias("id"), "number", "confidence", *BOX, *[c.alias(f"p{s}") for s, c in zip(BOX, points_box(points), strict=True)])


_LINE = "({o} / greatest(1.0, {m}) >= 0.55 OR abs((a.{lo} + a.{hi}) / 2 - (b.{lo} + b.{hi}) / 2) <= greatest(12.0, greatest(1.0, {m}) * 0.16::DOUBLE))"
_OX, _OY = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0)", "greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0)"
_DX, _DY = "greatest(greatest(a.x0, b.x0) - least(a.x1, b.x1), 0.0)", "greatest(greatest(a.y0, b.y0) - least(a.y1, b.y1), 0.0)"
_MW, _MH = "least(a.x1 - a.x0, b.x1 - b.x0)", "least(a.y1 - a.y0, b.y1 - b.y0)"
_GROUPED = f"(({_LINE.format(o=_OX, m=_MW, lo='x0', hi='x1')} AND {_DY} <= greatest(18.0, {_MH} * 0.35::DOUBLE)) OR ({_LINE.format(o=_OY, m=_MH, lo='y0', hi='y1')} AND {_DX} <= greatest(24.0, {_MW} * 0.2::DOUBLE)))"
_BETWEEN = """EXISTS (SELECT 1 FROM atoms t WHERE t.page_idx = a.page_idx AND t.kind = 'text_block' AND t.text LIKE 'Figure %' AND (a.y1 <= b.y0 OR b.y1 <= a.y0) AND CASE WHEN a.y1 <= b.y0 THEN b.y0 > a.y1 ELSE a.y0 > b.y1 END
 AND (t.y0 + t.y1) / 2 BETWEEN CASE WHEN a.y1 <= b.y0 THEN a.y1 ELSE b.y1 END - 2 AND CASE WHEN a.y1 <= b.y0 THEN b.y0 ELSE a.y0 END + 2 AND greatest(least(greatest(a.x1, b.x1), t.x1) - greatest(least(a.x0, b.x0), t.x0), 0.0) / greatest(1.0, greatest(a.x1, b.x1) - least(a.x0, b.x0)) >= 0.2)"""


@query(
    f"""WITH RECURSIVE {WITH_ATOMS[5:]}, mk AS (SELECT *, {_NUMBER} AS number FROM atoms WHERE kind = 'text_block' AND {_NUMBER} IS NOT NULL),
 scope AS (SELECT page_idx, ord, number FROM (SELECT i.page_idx, i.ord, m.number, row_number() OVER (PARTITION BY i.page_idx, i.ord ORDER BY greatest(m.y0 - i.y1, 0.0), least(i.x1, m.x1) - greatest(i.x0, m.x0) DESC, m.number) AS n FROM atoms i JOIN mk m USING (page_idx) WHERE i.kind = 'raster_image'
  AND (least(i.x1, m.x1) - greatest(i.x0, m.x0)) / greatest(least(i.x1 - i.x0, m.x1 - m.x0), 1.0) >= 0.2 AND m.y0 >= i.y0 - greatest(16.0, (i.y1 - i.y0) * 0.25) AND greatest(m.y0 - i.y1, 0.0) <= greatest(96.0, 760 * 0.33)) WHERE n = 1),
 im AS MATERIALIZED (SELECT a.*, s.number FROM atoms a LEFT JOIN scope s USING (page_idx, ord) WHERE kind = 'raster_image'), links AS MATERIALIZED (SELECT a.page_idx, a.ord AS a, b.ord AS b FROM im a JOIN im b ON a.page_idx = b.page_idx AND a.ord <> b.ord WHERE coalesce(a.number = b.number, true) AND {_GROUPED} AND NOT {_BETWEEN}),
 walk AS (SELECT page_idx, ord, ord AS c FROM im UNION SELECT w.page_idx, w.ord, l.b FROM walk w JOIN links l ON l.page_idx = w.page_idx AND l.a = w.c) SELECT page_idx, ord, min(c) AS cluster FROM walk GROUP BY 1, 2"""
)
def raster_groups(spark: SparkSession, d: str) -> DataFrame:
    a = stored_atoms(spark, d)
    images = a.where("kind = 'raster_image'")
    return n.raster_groups(images, a.where("kind = 'text_block'"), scope_numbers(images, a, HEIGHT))


_F = _flags_sql(600, 760)
_FRONT = f"CASE WHEN text_height IS NULL THEN false ELSE NOT ({_F['hidden_background']}) END"
_NESTED = f"({inter_sql('a.', 'b.')} > 0 AND {inter_sql('a.', 'b.')} / least({area_sql('a.')}, {area_sql('b.')}) >= 0.86::DOUBLE AND greatest({area_sql('a.')}, {area_sql('b.')}) / least({area_sql('a.')}, {area_sql('b.')}) >= 1.18::DOUBLE)"
_SUBORDINATE = f"({area_sql('b.')} < {area_sql('a.')} * 0.16::DOUBLE AND {gap_sql('a.', 'b.')} <= greatest(4.0, least(a.x1 - a.x0, a.y1 - a.y0) * 0.12::DOUBLE) AND greatest({_OX} / {_MW}, {_OY} / {_MH}) >= 0.45::DOUBLE)"
_ASPECT = "(greatest(x1 - x0, y1 - y0, 1.0) / greatest(least(x1 - x0, y1 - y0), 1.0))"


def _pad_sql(by: str) -> str:
    return f"greatest(x0 - {by}, 0.0) AS x0, greatest(y0 - {by}, 0.0) AS y0, least(x1 + {by}, 600.0) AS x1, least(y1 + {by}, 760.0) AS y1"


@query(
    f"""WITH RECURSIVE {WITH_ATOMS[5:]}, h AS (SELECT page_idx, CAST(page_idx % 4 * 5 AS DOUBLE) AS text_height FROM pages), v AS MATERIALIZED (SELECT * FROM (SELECT a.*, h.text_height FROM atoms a JOIN h USING (page_idx) WHERE kind IN ('raster_image', 'vector_cluster')) WHERE {_FRONT}),
 lone AS (SELECT page_idx, ord AS source, {_pad_sql('greatest(8.0, least(18.0, text_height * 0.8::DOUBLE))')}, 1 AS members, CASE WHEN kind = 'raster_image' THEN 0.18 ELSE 0.16 END AS score, 'seed_free_isolated_visual' AS evidence FROM v a WHERE NOT {_F['edge_tiny']} AND {area_sql('')} / 456000 >= 0.001 AND {area_sql('')} / 456000 <= CASE WHEN kind = 'raster_image' THEN 0.08 ELSE 0.12 END AND {_ASPECT} <= CASE WHEN kind = 'raster_image' THEN 4 ELSE 6 END
  AND (kind = 'raster_image' OR NOT EXISTS (SELECT 1 FROM v b WHERE b.page_idx = a.page_idx AND b.ord <> a.ord AND NOT {_NESTED} AND NOT {_SUBORDINATE} AND {gap_sql('a.', 'b.')} <= greatest(18.0, a.text_height * 2.5)))),
 cv AS MATERIALIZED (SELECT * FROM v WHERE NOT {_F['edge_tiny']}), links AS MATERIALIZED (SELECT a.page_idx, a.ord AS a, b.ord AS b FROM cv a JOIN cv b ON a.page_idx = b.page_idx AND a.ord <> b.ord WHERE {gap_sql('a.', 'b.')} <= greatest(18.0, a.text_height * 2.5)),
 walk AS (SELECT page_idx, ord, ord AS c FROM cv UNION SELECT w.page_idx, w.ord, l.b FROM walk w JOIN links l ON l.page_idx = w.page_idx AND l.a = w.c), member AS (SELECT page_idx, ord, min(c) AS cluster FROM walk GROUP BY 1, 2),
 g AS (SELECT page_idx, cluster AS source, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS members, bool_and(kind = 'vector_cluster') AS vectors, any_value(text_height) AS text_height FROM member JOIN cv USING (page_idx, ord) GROUP BY 1, 2 HAVING count(*) >= 2),
 gp AS (SELECT page_idx, source, {_pad_sql('greatest(12.0, least(40.0, text_height * 2))')}, members, vectors FROM g), ge AS (SELECT *, CAST(x0 <= 12 AS INT) + CAST(y0 <= 12 AS INT) + CAST(x1 >= 588 AS INT) + CAST(y1 >= 748 AS INT) AS edges FROM gp),
 every AS (SELECT page_idx, source, x0, y0, x1, y1, members, CAST(score AS DOUBLE) AS score, evidence FROM lone UNION ALL SELECT page_idx, source, x0, y0, x1, y1, members, CAST(0.22 AS DOUBLE) + members * CAST(0.02 AS DOUBLE), 'seed_free_compact_visual' FROM ge WHERE {area_sql('')} / 456000 <= CASE WHEN vectors AND edges = 0 AND {_ASPECT} <= 3.5 THEN 0.22 ELSE 0.12 END AND NOT (edges >= 1 AND {_ASPECT} >= 4))
 SELECT *, row_number() OVER (PARTITION BY page_idx ORDER BY round(score, 6) DESC, evidence, source) AS place FROM every"""
)
def free_seeds(spark: SparkSession, d: str) -> DataFrame:
    visuals = stored_atoms(spark, d).where(F.col("kind").isin("raster_image", "vector_cluster")).withColumn("text_height", (F.col("page_idx") % 4 * 5).cast("double"))
    return n.free_seeds(visuals, WIDTH, HEIGHT)


_SOURCES = ("raster_split_proposal", "raster_pixel_content", "primitive_evidence_region", "raster_anchor_union", "other")
_STRATEGIES = ("raster_content_branch", "coarse_nonraster_decomposition", "other")
_KINDS = ("localized", "primitive_localized", "compound")
_MR = f"({area_sql('b.')} / {area_sql('a.')})"
_T = {"left": "greatest(b.x0 - a.x0, 0.0) / (a.x1 - a.x0)", "top": "greatest(b.y0 - a.y0, 0.0) / (a.y1 - a.y0)", "right": "greatest(a.x1 - b.x1, 0.0) / (a.x1 - a.x0)", "bottom": "greatest(a.y1 - b.y1, 0.0) / (a.y1 - a.y0)"}
_SRC, _STR, _KND = (f"[{', '.join(repr(v) for v in vs)}][{e} % {len(vs)} + 1]" for vs, e in ((_SOURCES, "a.xref"), (_STRATEGIES, "b.xref"), (_KINDS, "(a.xref + b.xref)")))
_D = lambda x: f"CAST({x} AS DOUBLE)"
_OWN, _EXC, _ANC, _EVI = "(b.xref % 7)", "(a.xref % 4)", "(a.xref % 3)", "(b.xref % 15)"
_OBJ = f"""(CASE WHEN {_ANC} > 0 THEN least({_ANC}, {_OWN}) / {_ANC} ELSE 0.0 END * {_D(0.3)} + CASE WHEN {_OWN} > 0 THEN {_OWN} / greatest(1, {_OWN} + {_EXC}) ELSE 0.0 END * {_D(0.15)} + a.xref % 10 / 10 * {_D(0.2)} + least(1.0, b.xref * 150.0 / {area_sql('a.')}) * {_D(0.15)} + least(1.0, sqrt({_OWN}) / 2) * {_D(0.2)}) * greatest(1.0, sqrt({_OWN}))
 + CASE WHEN {_KND} = 'localized' AND {_EXC} > 0 THEN least({_D(0.8)}, {_D(0.35)} + {_EXC} * {_D(0.15)}) WHEN {_KND} = 'primitive_localized' THEN least({_D(0.35)}, greatest(1, b.xref % 6) * {_D(0.08)}) ELSE 0.0 END - CASE WHEN {_KND} = 'compound' AND a.xref % 2 > 0 THEN least(1.0, a.xref % 2 * {_D(0.8)}) ELSE 0.0 END"""
_BRA = f"""1.0 + b.xref % 3 / 10 + greatest(1 - {_MR}, 0.0) * {_D(0.9)} + least({_EVI}, 12) * {_D(0.08)} + least(a.xref % 9, 6) * {_D(0.04)} + CASE WHEN {_EXC} > 0 THEN {_EXC} / greatest(1, {_OWN} + {_EXC}) ELSE 0.0 END * {_D(0.25)} + least(sqrt({_OWN}), 2.0) * {_D(0.25)}
 + (CASE WHEN b.xref % 4 = 0 THEN {_D(0.45)} ELSE 0.0 END + CASE WHEN b.xref % 4 = 0 AND {_EVI} >= 12 THEN {_D(0.1)} ELSE 0.0 END + CASE WHEN {_SRC} = 'raster_pixel_content' THEN {_D(0.12)} ELSE 0.0 END) - CASE WHEN {_MR} < {_D(0.35)} THEN ({_D(0.35)} - {_MR}) * 2 ELSE 0.0 END"""
_PRO = f"""CASE WHEN {_SRC} = 'raster_split_proposal' OR {_EXC} > 0 THEN -1.0 ELSE ({_MR} - {_D(0.78)}) * 4 + ({inter_sql('a.', 'b.')} / least({area_sql('a.')}, {area_sql('b.')}) - {_D(0.98)}) * {_D(1.5)} - greatest(greatest({', '.join(_T.values())}) - {_D(0.03)}, 0.0) * 4 - greatest({' + '.join(_T.values())} - {_D(0.12)}, 0.0) * {_D(1.5)} END"""
_QUA = f"""{_MR} >= CASE WHEN {_SRC} = 'raster_split_proposal' THEN 0 WHEN {_STR} = 'raster_content_branch' OR {_SRC} = 'raster_pixel_content' THEN CASE WHEN a.xref % 6 = 0 THEN {_D(0.55)} WHEN {_SRC} = 'raster_pixel_content' AND b.xref % 2 = 0 THEN {_D(0.6)} ELSE {_D(0.78)} END WHEN {_STR} = 'coarse_nonraster_decomposition' THEN {_D(0.3)} WHEN b.xref % 4 = 0 THEN {_D(0.18)} WHEN {_SRC} = 'primitive_evidence_region' THEN 0.5 ELSE 0.25 END"""


@query(
    f"""{WITH_ATOMS} SELECT a.page_idx, a.ord AS a_ord, b.ord AS b_ord, {round_sql(f'greatest({_OBJ}, 0.0)')} AS object_score, {round_sql(f'greatest({_BRA}, 0.0)')} AS branch_score, {round_sql(_PRO, 6)} AS promotion, {_QUA} AS figure_quality,
 CASE WHEN {_SRC} = 'raster_anchor_union' THEN {_MR} <= 0.75 WHEN {_SRC} = 'raster_split_proposal' THEN true ELSE {_MR} >= 0.78::DOUBLE END AS single_raster FROM atoms a JOIN atoms b ON a.page_idx = b.page_idx AND a.ord < b.ord WHERE {gap_sql('a.', 'b.')} <= 24"""
)
def object_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of objects and content branches over pairs of neighbours: the left one the support, the right one the content."""
    from pagefold.functions.geometry import gap

    pairs = self_pairs(stored_atoms(spark, d).select("page_idx", "ord", *BOX, "xref"), reach=24.0, where=gap("a_", "b_") <= 24)
    a, b = F.col("a_xref"), F.col("b_xref")
    pick = lambda vs, e: F.element_at(F.array(*[F.lit(v) for v in vs]), (e % len(vs) + 1).cast("int"))
    source, strategy, kind = pick(_SOURCES, a), pick(_STRATEGIES, b), pick(_KINDS, a + b)
    owned, excluded, anchors, evidence = b % 7, a % 4, a % 3, b % 15
    return pairs.select(
        "page_idx", "a_ord", "b_ord",
        n.object_score(anchors, F.least(anchors, owned), owned, excluded, b * 150.0, "a_", a % 10 / 10, kind, a % 2, b % 6).alias("object_score"),
        n.branch_score("a_", "b_", owned, excluded, evidence, a % 9, b % 4 == 0, source == "raster_pixel_content", b % 3 / 10).alias("branch_score"),
        F.round(n.promotion_score("a_", "b_", (source == "raster_split_proposal") | (excluded > 0)), 6).alias("promotion"),
        n.has_figure_quality("a_", "b_", strategy, source, a % 6 == 0, b % 2 == 0, b % 4 == 0).alias("figure_quality"),
        n.keeps_single_raster("a_", "b_", source).alias("single_raster"),
    )


_INST = "inst AS MATERIALIZED (SELECT page_idx, ord, x0, y0, x1, y1, xref % 6 AS score, [ord, xref % 4] AS visuals FROM atoms UNION ALL SELECT page_idx, ord + 1000, x0, y0, x1, y1, ord % 5, [ord, ord % 3] FROM preds)"


def _instance_sql(rounds: int = 5) -> str:
    shared = "len(list_intersect(a.visuals, b.visuals)) / greatest(1, least(len(list_distinct(a.visuals)), len(list_distinct(b.visuals))))"
    alike = f"({shared} >= 0.9 AND {inter_sql('a.', 'b.')} / least({area_sql('a.')}, {area_sql('b.')}) >= 0.75)"
    parts = [_INST, f"v0 AS MATERIALIZED (SELECT a.page_idx, a.ord AS better, b.ord AS worse FROM inst a JOIN inst b ON a.page_idx = b.page_idx AND (-a.score, a.ord) < (-b.score, b.ord) AND {inter_sql('a.', 'b.')} > 0 AND ({iou_sql('a.', 'b.')} > 0.95 OR {alike}))"]
    for i in range(rounds):
        parts.append(f"o{i} AS MATERIALIZED (SELECT DISTINCT page_idx, worse AS ord FROM v{i} r WHERE NOT EXISTS (SELECT 1 FROM v{i} x WHERE x.page_idx = r.page_idx AND x.worse = r.better))")
        parts.append(f"v{i + 1} AS MATERIALIZED (SELECT * FROM v{i} r WHERE NOT EXISTS (SELECT 1 FROM o{i} o WHERE o.page_idx = r.page_idx AND o.ord IN (r.better, r.worse)))")
    gone = " UNION ALL ".join(f"SELECT * FROM o{i}" for i in range(rounds))
    return f"{WITH_ATOMS}, {', '.join(parts)} SELECT page_idx, ord, score FROM inst WHERE NOT EXISTS (SELECT 1 FROM ({gone}) g WHERE g.page_idx = inst.page_idx AND g.ord = inst.ord)"


@query(_instance_sql())
def distinct_instances(spark: SparkSession, d: str) -> DataFrame:
    a = stored_atoms(spark, d)
    x, o = F.col("xref").cast("int"), F.col("ord")
    first = a.select("page_idx", "ord", *BOX, (x % 6).alias("score"), F.array_distinct(F.array(o, x % 4)).alias("visuals"))
    more = predictions(spark, d, a).select("page_idx", (o + 1000).alias("ord"), *BOX, (o % 5).alias("score"), F.array_distinct(F.array(o, o % 3)).alias("visuals"))
    return n.distinct_instances(first.unionByName(more)).select("page_idx", "ord", "score")


@query(f"{WITH_ATOMS} SELECT page_idx, kind, id, confidence, object_score FROM (SELECT page_idx, kind, ord AS id, xref % 4 / 4 AS confidence, xref % 5 AS object_score, row_number() OVER (PARTITION BY page_idx, kind ORDER BY xref % 4 DESC, xref % 5 DESC, {area_sql('')} DESC, ord DESC) AS n FROM atoms) WHERE n = 1")
def best_boundaries(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.sources.layouts import atoms

    c = atoms(spark, d).select("page_idx", "kind", F.col("ord").alias("id"), (F.col("xref") % 4 / 4).alias("confidence"), (F.col("xref") % 5).alias("object_score"), *BOX)
    return n.best_boundaries(c, "page_idx", "kind").select("page_idx", "kind", "id", "confidence", "object_score")


