"""Queries of figure candidates, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.operators import candidates as c
from pagefold.operators import groups
from pagefold.operators.layout import line_spacing, typography
from pagefold.plans.layout_queries import SQL as LAYOUT_SQL, WITH_ATOMS, area_sql, gap_sql, inter_sql, iou_sql, round_sql, suppress_sql
from pagefold.sources.layouts import HEIGHT, WIDTH, atoms, stored_atoms

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_W, _H = "(x1 - x0)", "(y1 - y0)"
_BOXES = ("x0", "y0", "x1", "y1")


@query(
    f"""{WITH_ATOMS} SELECT page_idx, ord, CASE WHEN xref % 2 = 0 AND {_W} >= 80 AND {_H} >= 80 THEN 'panel_border' WHEN xref % 3 = 0 AND {_W} >= 80 AND {_H} >= 12 AND {_W} / greatest({_H}, 1.0) >= 2 THEN 'color_band' WHEN {_W} >= 24 AND {_H} >= 24 THEN 'vector_cluster'
 WHEN least({_W}, {_H}) >= 8 AND greatest({_W}, {_H}) >= 80 AND greatest({_W}, {_H}) / greatest(least({_W}, {_H}), 1.0) >= 4 THEN 'vector_cluster' END AS kind,
 CASE WHEN {_W} >= 80 AND {_H} <= greatest(6.0, xref % 20 * 4.0) THEN 'horizontal' WHEN {_H} >= 80 AND {_W} <= greatest(6.0, xref % 20 * 4.0) THEN 'vertical' END AS orientation FROM atoms"""
)
def drawing_classes(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("xref")
    return atoms(spark, d).select("page_idx", "ord", c.drawing_kind(x % 2 == 0, x % 3 == 0).alias("kind"), c.stroke_orientation((x % 20).cast("double")).alias("orientation"))


_CLIPPED = ("least(greatest(x0, 0.0), 480.0)", "least(greatest(y0, 0.0), 640.0)", "greatest(least(greatest(x0, 0.0), 480.0), least(x1, 480.0))", "greatest(least(greatest(y0, 0.0), 640.0), least(y1, 640.0))")
_CL_AREA = f"(({_CLIPPED[2]} - {_CLIPPED[0]}) * ({_CLIPPED[3]} - {_CLIPPED[1]}))"


@query(
    f"""{WITH_ATOMS} SELECT page_idx, ord, CASE WHEN kind NOT IN ('panel_border', 'color_band') THEN CASE WHEN xref % 3 = 0 AND {_CL_AREA} > 0 THEN CASE WHEN {_CL_AREA} >= 16 AND {_CL_AREA} / 307200 < 0.75 AND CAST({_CLIPPED[0]} <= 12 AS INT) + CAST({_CLIPPED[1]} <= 12 AS INT) + CAST({_CLIPPED[2]} >= 468 AS INT) + CAST({_CLIPPED[3]} >= 628 AS INT) < 3 THEN 'fill' END
 WHEN xref % 5 <> 0 THEN CASE WHEN {_W} >= 80 AND {_H} <= greatest(6.0, xref % 20 * 4.0) THEN 'horizontal' WHEN {_H} >= 80 AND {_W} <= greatest(6.0, xref % 20 * 4.0) THEN 'vertical' END END END AS fragment FROM atoms"""
)
def composite_fragments(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("xref")
    fragment = c.composite_fragment(F.col("kind"), F.when(x % 5 != 0, "s").otherwise("f"), x % 3 == 0, c.stroke_orientation((x % 20).cast("double")), 480.0, 640.0)
    return atoms(spark, d).select("page_idx", "ord", fragment.alias("fragment"))


@query(
    f"""WITH RECURSIVE {WITH_ATOMS[5:]}, v AS MATERIALIZED (SELECT * FROM atoms WHERE kind <> 'text_block'), links AS MATERIALIZED (SELECT a.page_idx, a.ord AS a, b.ord AS b FROM v a JOIN v b ON a.page_idx = b.page_idx AND a.ord <> b.ord WHERE {gap_sql('a.', 'b.')} <= 12),
 walk AS (SELECT page_idx, ord, ord AS c FROM v UNION SELECT w.page_idx, w.ord, l.b FROM walk w JOIN links l ON l.page_idx = w.page_idx AND l.a = w.c), member AS (SELECT page_idx, ord, min(c) AS cluster FROM walk GROUP BY 1, 2),
 g AS (SELECT page_idx, cluster, min(x0) AS x0, min(y0) AS y0, least(max(x1), 600.0) AS x1, least(max(y1), 760.0) AS y1, count(*) AS members, count(*) FILTER (xref % 3 = 1) AS horizontal, count(*) FILTER (xref % 3 = 2) AS vertical, count(*) FILTER (xref % 3 = 0) AS fills, min((y0, x0, ord)) AS first FROM member JOIN v USING (page_idx, ord) GROUP BY 1, 2),
 good AS (SELECT *, cluster AS ord FROM g WHERE members >= 3 AND {area_sql('')} > 0 AND {area_sql('')} / (600 * 760) < 0.75 AND CAST(x0 <= 12 AS INT) + CAST(y0 <= 12 AS INT) + CAST(x1 >= 588 AS INT) + CAST(y1 >= 748 AS INT) < 3 AND x1 - x0 >= 24 AND y1 - y0 >= 24
  AND CASE WHEN fills > 0 THEN horizontal + vertical >= 2 OR (fills >= 6 AND fills >= members - 1 AND {area_sql('')} >= 900) ELSE horizontal >= 3 AND vertical >= 2 END), {suppress_sql('good', 'first', 0.95, 1.0, 3)}
 SELECT page_idx, cluster, x0, y0, x1, y1, members, horizontal, vertical, fills FROM settled WHERE kept"""
)
def composite_drawings(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("xref") % 3
    parts = stored_atoms(spark, d).where("kind <> 'text_block'").select("page_idx", "ord", "x0", "y0", "x1", "y1", F.when(x == 1, "horizontal").when(x == 2, "vertical").alias("orientation"), (x == 0).alias("filled"))
    return c.composites(parts, WIDTH, HEIGHT)


def _distinct_sql(rounds: int = 3) -> str:
    same = f"({iou_sql('a.', 'b.')} > 0.95 OR {inter_sql('a.', 'b.')} / least({area_sql('a.')}, {area_sql('b.')}) > 0.98)"
    parts = ["im0 AS (SELECT page_idx, ord, x0, y0, x1, y1, CASE WHEN xref % 2 = 0 THEN 'xref' ELSE 'text_dict' END AS source FROM atoms WHERE kind = 'raster_image')", "im1 AS (SELECT * FROM im0 UNION ALL SELECT page_idx, ord + 500, x0 + ord % 3, y0 + ord % 3, x1 + ord % 3, y1 + ord % 3, 'xref' FROM im0)",
     f"im AS MATERIALIZED (SELECT page_idx, ord, least(x0, 600.0) AS x0, least(y0, 760.0) AS y0, greatest(least(x0, 600.0), least(x1, 600.0)) AS x1, greatest(least(y0, 760.0), least(y1, 760.0)) AS y1, source FROM im1 WHERE (least(x1, 600.0) - least(x0, 600.0)) * (least(y1, 760.0) - least(y0, 760.0)) >= 64)",
     f"v0 AS MATERIALIZED (SELECT a.page_idx, a.ord AS better, b.ord AS worse FROM im a JOIN im b ON a.page_idx = b.page_idx AND b.source = 'xref' AND (a.source = 'xref', a.ord) < (true, b.ord) AND a.ord <> b.ord AND {same})"]
    for i in range(rounds):
        parts.append(f"o{i} AS MATERIALIZED (SELECT DISTINCT page_idx, worse AS ord FROM v{i} r WHERE NOT EXISTS (SELECT 1 FROM v{i} x WHERE x.page_idx = r.page_idx AND x.worse = r.better))")
        parts.append(f"v{i + 1} AS MATERIALIZED (SELECT * FROM v{i} r WHERE NOT EXISTS (SELECT 1 FROM o{i} o WHERE o.page_idx = r.page_idx AND o.ord IN (r.better, r.worse)))")
    gone = " UNION ALL ".join(f"SELECT * FROM o{i}" for i in range(rounds))
    return f"{WITH_ATOMS}, {', '.join(parts)} SELECT * FROM im WHERE NOT EXISTS (SELECT 1 FROM ({gone}) g WHERE g.page_idx = im.page_idx AND g.ord = im.ord)"


@query(_distinct_sql())
def distinct_images(spark: SparkSession, d: str) -> DataFrame:
    a = stored_atoms(spark, d).where("kind = 'raster_image'").select("page_idx", "ord", *_BOXES, F.when(F.col("xref") % 2 == 0, "xref").otherwise("text_dict").alias("source"))
    copies = a.select("page_idx", (F.col("ord") + 500).alias("ord"), *[(F.col(s) + F.col("ord") % 3).alias(s) for s in _BOXES], F.lit("xref").alias("source"))
    return c.distinct_images(a.unionByName(copies), WIDTH, HEIGHT)


@query(
    f"""{WITH_ATOMS}, p AS (SELECT *, lag(x0) OVER u AS ax0, lag(x1) OVER u AS ax1, lag(y0) OVER u AS ay0, lag(y1) OVER u AS ay1, lag(x0) OVER v AS bx0, lag(x1) OVER v AS bx1, lag(y1) OVER v AS by1 FROM atoms WHERE kind = 'raster_image' WINDOW u AS (PARTITION BY page_idx ORDER BY x0, ord), v AS (PARTITION BY page_idx ORDER BY y0, ord)),
 s AS (SELECT *, x0 - ax1 AS gx, y0 - by1 AS gy, CASE WHEN ay0 IS NOT NULL THEN (least(y1, ay1) - greatest(y0, ay0)) / greatest(least(y1 - y0, ay1 - ay0), 1.0) END AS cx, CASE WHEN bx0 IS NOT NULL THEN (least(x1, bx1) - greatest(x0, bx0)) / greatest(least(x1 - x0, bx1 - bx0), 1.0) END AS cy FROM p),
 g AS (SELECT page_idx, count(*) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum({area_sql('')}) AS total, median(x1 - x0) AS w, median(y1 - y0) AS h, max(x0) - min(x0) AS dx0, max(x1) - min(x1) AS dx1, max(y0) - min(y0) AS dy0, max(y1) - min(y1) AS dy1, max(abs(gx)) AS gx, max(abs(gy)) AS gy, min(cx) AS cx, min(cy) AS cy FROM s GROUP BY 1),
 t AS (SELECT *, greatest(dx0, dx1) <= greatest(8.0, w * 0.2) AND gy <= greatest(24.0, h * 0.25) AND cy >= 0.8 AS in_column, greatest(dy0, dy1) <= greatest(8.0, h * 0.2) AND gx <= greatest(24.0, w * 0.25) AND cx >= 0.8 AS in_row FROM g WHERE members >= 2)
 SELECT page_idx, members, x0, y0, x1, y1, CASE WHEN in_column THEN 'column' ELSE 'row' END AS strip FROM t WHERE {area_sql('')} / total <= 1.35 AND (in_column OR in_row)"""
)
def raster_strips(spark: SparkSession, d: str) -> DataFrame:
    return c.raster_strips(atoms(spark, d).where("kind = 'raster_image'"), "page_idx")


_PROPOSALS = f"""{WITH_ATOMS}, sup AS MATERIALIZED (SELECT page_idx, ord, x0 - 20 AS x0, y0 - 20 AS y0, x1 + 60 AS x1, y1 + 60 AS y1 FROM atoms WHERE kind = 'panel_border'),
 held AS MATERIALIZED (SELECT s.page_idx, s.ord, m.kind, m.x0 AS m_x0, m.y0 AS m_y0, m.x1 AS m_x1, m.y1 AS m_y1 FROM sup s JOIN atoms m USING (page_idx) WHERE (m.x0 + m.x1) / 2 BETWEEN s.x0 AND s.x1 AND (m.y0 + m.y1) / 2 BETWEEN s.y0 AND s.y1),
 per AS (SELECT page_idx, ord, count(*) FILTER (kind <> 'text_block') AS v, count(*) FILTER (kind = 'raster_image') AS r, {', '.join(f"{f}(m_{s}) FILTER (kind <> 'text_block') AS u_{s}, max(m_{s}) FILTER (kind = 'raster_image') AS c_{s}" for s, f in zip(_BOXES, ('min', 'min', 'max', 'max'), strict=True))} FROM held GROUP BY 1, 2),
 prop AS MATERIALIZED (SELECT page_idx, ord, x0 AS s_x0, y0 AS s_y0, x1 AS s_x1, y1 AS s_y1, 'support_bbox' AS strategy, x0, y0, x1, y1, 0.0 AS bonus FROM sup
 UNION ALL SELECT s.page_idx, s.ord, x0, y0, x1, y1, 'visual_atom_union', u_x0, u_y0, u_x1, u_y1, 0.05 FROM sup s JOIN per USING (page_idx, ord) WHERE v > 0 UNION ALL SELECT s.page_idx, s.ord, x0, y0, x1, y1, 'single_raster_core', c_x0, c_y0, c_x1, c_y1, 0.12 FROM sup s JOIN per USING (page_idx, ord) WHERE r = 1),
 sums AS (SELECT p.page_idx, p.ord, strategy, x0, y0, x1, y1, s_x0, s_y0, s_x1, s_y1, bonus, coalesce(sum({area_sql('m_')}) FILTER (h.kind <> 'text_block'), 0.0) AS va, coalesce(sum({area_sql('m_')}) FILTER (h.kind = 'text_block'), 0.0) AS ta, coalesce(sum({inter_sql('', 'm_')}) FILTER (h.kind <> 'text_block'), 0.0) AS vi, coalesce(sum({inter_sql('', 'm_')}) FILTER (h.kind = 'text_block'), 0.0) AS ti FROM prop p LEFT JOIN held h ON h.page_idx = p.page_idx AND h.ord = p.ord GROUP BY ALL),
 parts AS (SELECT *, CASE WHEN va > 0 THEN vi / va ELSE 1.0 END AS keep, CASE WHEN ta > 0 THEN ti / ta ELSE 0.0 END AS txt, greatest(1 - {area_sql('')} / {area_sql('s_')}, 0.0) AS compact FROM sums)
 SELECT page_idx, ord, strategy, x0, y0, x1, y1, {round_sql('least(1.0, greatest(0.0, CAST(0.7 AS DOUBLE) * keep + CAST(0.2 AS DOUBLE) * (1 - txt) + CAST(0.1 AS DOUBLE) * compact - greatest(CAST(0.95 AS DOUBLE) - keep, 0.0) * 2 + CAST(bonus AS DOUBLE)))')} AS score FROM parts"""


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    a = stored_atoms(spark, d)
    grown = {s: F.col(s) + by for s, by in zip(_BOXES, (-20, -20, 60, 60), strict=True)}
    return c.boundary_proposals(a.where("kind = 'panel_border'").withColumns(grown), a)


@query(_PROPOSALS)
def boundary_proposals(spark: SparkSession, d: str) -> DataFrame:
    return _proposals(spark, d)


@query(f"SELECT page_idx, ord, strategy, x0, y0, x1, y1, score, proposals FROM (SELECT *, row_number() OVER (PARTITION BY page_idx, ord ORDER BY score DESC, strategy DESC) AS n, count(*) OVER (PARTITION BY page_idx, ord) AS proposals FROM ({_PROPOSALS})) WHERE n = 1")
def boundary_decisions(spark: SparkSession, d: str) -> DataFrame:
    return c.calibrated(_proposals(spark, d))


@query(f"{WITH_ATOMS} SELECT page_idx, xref % 4 AS group_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS members, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CASE WHEN min(text) = max(text) AND count(text) = count(*) THEN min(text) END AS operator FROM atoms GROUP BY 1, 2")
def primitive_groups(spark: SparkSession, d: str) -> DataFrame:
    return c.primitive_groups(atoms(spark, d).withColumns({"group_id": F.col("xref") % 4, "operator": F.col("text")}))


@query(
    f"""{WITH_ATOMS}, s AS (SELECT page_idx, xref % 3 AS block, ord, 8.0 + xref % 4 AS size, kind AS font, greatest(length(coalesce(text, '')), 1) AS n, length(trim(coalesce(text, ''))) AS chars, y0 FROM atoms),
 z AS (SELECT page_idx, block, size FROM (SELECT page_idx, block, size, row_number() OVER (PARTITION BY page_idx, block ORDER BY sum(n) DESC, min(ord)) AS k FROM s GROUP BY 1, 2, 3) WHERE k = 1), f AS (SELECT page_idx, block, font FROM (SELECT page_idx, block, font, row_number() OVER (PARTITION BY page_idx, block ORDER BY sum(n) DESC, min(ord)) AS k FROM s GROUP BY 1, 2, 3) WHERE k = 1),
 l AS (SELECT page_idx, block, avg(step) AS step FROM (SELECT page_idx, block, lead(y0) OVER (PARTITION BY page_idx, block ORDER BY y0, ord) - y0 AS step FROM s) GROUP BY 1, 2)
 SELECT s.page_idx, s.block, CAST(any_value(z.size) AS DOUBLE) AS dominant_font_size, any_value(f.font) AS dominant_font_name, sum(chars) AS chars, round(CAST(sum((s.size - z.size) * (s.size - z.size) * n) AS DOUBLE) / sum(n), 6) AS font_size_variance, coalesce(round(any_value(l.step) / 10, 4), 1.0) AS line_spacing_ratio
 FROM s JOIN z USING (page_idx, block) JOIN f USING (page_idx, block) LEFT JOIN l USING (page_idx, block) GROUP BY 1, 2"""
)
def typography_blocks(spark: SparkSession, d: str) -> DataFrame:
    s = atoms(spark, d).select("page_idx", (F.col("xref") % 3).alias("block"), "ord", F.coalesce("text", F.lit("")).alias("text"), (F.col("xref") % 4 + 8).cast("double").alias("size"), F.col("kind").alias("font"), "y0", F.lit(10.0).alias("ten"))
    return typography(s, ["page_idx", "block"]).join(line_spacing(s, ["page_idx", "block"], "ten"), ["page_idx", "block"])


_CLOSURES = f"""cl AS MATERIALIZED (SELECT r.page_idx, r.seed, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS nodes, count(*) FILTER (kind = 'raster_image') AS atoms FROM reach r JOIN atoms a ON a.page_idx = r.page_idx AND a.ord = r.node GROUP BY 1, 2),
 ev AS (SELECT *, CASE WHEN atoms > 1 THEN 'image_cluster' WHEN seed % 2 = 0 THEN 'visual_community' ELSE 'layout_column' END AS evidence, 0.1 * (seed % 9) AS seed_score, ['L0', 'L1', 'L2'][seed % 3 + 1] AS level, seed % 4 = 0 AS multi, seed % 2 AS captions, nodes > 2 AS supported FROM cl WHERE {area_sql('')} > 0)"""
_SCORED = """SELECT page_idx, seed, x0, y0, x1, y1, nodes, atoms, evidence, CAST(seed_score AS DOUBLE) AS seed_score, level, multi, captions, supported, score, CAST(row_number() OVER (PARTITION BY page_idx ORDER BY score DESC, seed) AS INTEGER) AS rank FROM (SELECT *, ROUNDED AS score FROM ev)"""
_SCORE = f"least(CAST(seed_score AS DOUBLE), CAST(CASE evidence WHEN 'image_cluster' THEN 0.65 WHEN 'visual_community' THEN 0.35 ELSE 0.8 END AS DOUBLE)) + {round_sql('ln(1 + nodes) * 0.2::DOUBLE + ln(1 + atoms) * 0.12::DOUBLE')} + CAST(CASE level WHEN 'L1' THEN 0.1 WHEN 'L2' THEN 0.2 ELSE 0 END AS DOUBLE) - greatest({area_sql('')} / 456000 - 0.25, 0.0) * CASE WHEN evidence = 'visual_community' THEN 2.0 ELSE 0.0 END - CAST(CASE WHEN evidence = 'visual_community' AND captions = 0 AND supported THEN 1.2 ELSE 0 END AS DOUBLE) - CAST(CASE WHEN multi THEN 0.9 ELSE 0 END AS DOUBLE)"


def _closures(spark: SparkSession, d: str) -> DataFrame:
    """Closures of the page graph with made-up evidence."""
    from pagefold.plans.layout_queries import graph_closure

    a = stored_atoms(spark, d)
    reached = graph_closure(spark, d).join(a.withColumnRenamed("ord", "node"), ["page_idx", "node"])
    boxes = reached.groupBy("page_idx", "seed").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("kind") == "raster_image").alias("atoms"), F.sort_array(F.collect_list("node")).alias("node_ids"), F.sort_array(F.collect_list(F.when(F.col("kind") == "raster_image", F.col("node")))).alias("raster_ids"), *[F.count_if(F.col("kind") == k).alias(n) for n, k in (("vectors", "vector_cluster"), ("borders", "panel_border"), ("bands", "color_band"))])
    seed = F.col("seed")
    return boxes.withColumns(
        {
            "evidence": F.when(F.col("atoms") > 1, "image_cluster").when(seed % 2 == 0, "visual_community").otherwise("layout_column"), "seed_score": (seed % 9).cast("decimal(3,1)").cast("double") / 10,
            "level": F.element_at(F.array(F.lit("L0"), F.lit("L1"), F.lit("L2")), seed % 3 + 1), "multi": seed % 4 == 0, "captions": seed % 2, "supported": F.col("nodes") > 2,
        }
    )


_REACH = LAYOUT_SQL["graph_closure"].rsplit(" SELECT w.page_idx", 1)


@query(f"{_REACH[0]}, reach AS (SELECT w.page_idx{_REACH[1]}), {_CLOSURES} {_SCORED.replace('ROUNDED', round_sql(_SCORE))}")
def ranked_closures(spark: SparkSession, d: str) -> DataFrame:
    return c.closure_scores(_closures(spark, d).drop("node_ids", "raster_ids", "vectors", "borders", "bands"), WIDTH * HEIGHT)


@query()
def selected_closures(spark: SparkSession, d: str) -> DataFrame:
    """Closures ranked by score, overlapping ones suppressed, displaced or kept by the rules; ``kept`` says which stay."""
    from pagefold.operators.ranking import rank_closures

    seed = F.col("seed")
    scored = c.closure_scores(_closures(spark, d), WIDTH * HEIGHT).drop("rank")
    kinds = F.array(*[F.lit(k) for k in ("visual_community", "image_seed", "caption_anchor_visual", "seed_free_compact_visual", "border", "captioned_image_seed", "layout_column", "seed_free_isolated_visual")])
    kind = F.element_at(kinds, (seed % 8 + 1).cast("int"))
    items = scored.select(
        "page_idx", "seed", "score", *_BOXES, kind.alias("kind"), F.when(kind.startswith("seed_free"), "seed_free").otherwise("panel_candidate").alias("provenance"), F.col("nodes").alias("members"), "multi", (seed % 5 == 0).alias("numbered"),
        F.when(seed % 3 == 0, F.array(seed)).when(seed % 3 == 1, F.array(seed % 2)).otherwise(F.array().cast("array<int>")).alias("captions"), F.array(seed).alias("sources"), F.col("node_ids").alias("atoms"), "raster_ids", F.col("atoms").alias("rasters"), "vectors", "borders", "bands",
    )
    return rank_closures(items, WIDTH).select("page_idx", "seed", "score", "kind", "rank", "kept")


_STAGED = f"{WITH_ATOMS}, one_ AS (SELECT page_idx, ord, x0, y0, x1, y1, xref FROM atoms), {suppress_sql('one_', 'xref DESC, ord', 0.8, 0.9, 4)}"


@query(f"{_STAGED} SELECT page_idx, ord, 'suppression' AS stage, CASE WHEN kept THEN 'selected' ELSE 'suppressed' END AS decision, CASE WHEN NOT kept THEN 'overlaps_better' END AS reason, 0.8 AS threshold, round(xref / 97.0, 4) AS score FROM settled")
def lifecycle_events(spark: SparkSession, d: str) -> DataFrame:
    a = stored_atoms(spark, d).select("page_idx", "ord", "x0", "y0", "x1", "y1", "xref")
    kept = groups.suppress(a, [F.col("xref").desc(), F.col("ord").asc()]).where("kept")
    return c.lifecycle(a.withColumn("score", F.round(F.col("xref") / 97.0, 4)), kept, "suppression", "overlaps_better", 0.8)


_EIGHT = ("visual_community", "image_seed", "caption_anchor_visual", "seed_free_compact_visual", "border", "captioned_image_seed", "layout_column", "image_cluster")
_IT = f"""{WITH_ATOMS}, src AS (SELECT page_idx, ord, x0, y0, x1, y1, xref FROM atoms UNION ALL SELECT page_idx, ord + 1000, x0, y0, x1, y1, ord % 5 FROM preds),
 it AS MATERIALIZED (SELECT page_idx, ord, x0, y0, x1, y1, [{', '.join(repr(k) for k in _EIGHT)}][(xref + ord) % 8 + 1] AS kind, xref % 5 AS members, xref % 7 = 0 AS multi, xref % 5 = 0 AS numbered, CASE xref % 3 WHEN 0 THEN [ord % 2] WHEN 1 THEN [xref % 2] ELSE [] END AS captions,
  CASE WHEN xref % 2 = 0 THEN [ord] ELSE [ord, ord % 1000] END AS sources, [ord % 1000, xref % 3] AS atoms, [ord % 1000] AS raster_ids, xref % 4 AS rasters, xref % 3 AS vectors, xref % 2 AS borders, ord % 2 AS bands, (xref % 10 + 1) / 10 AS score FROM src)"""


def _verdict_sql(a: str, b: str) -> str:
    """The verdict on ``b`` after ``a``, said once more in SQL."""
    ar, inter = area_sql, inter_sql(a, b)
    cover = f"({inter} / least({ar(a)}, {ar(b)}))"
    images = "('image_cluster', 'image_seed', 'captioned_image_seed')"
    visuals = lambda p: f"({p}rasters + {p}vectors + {p}borders + {p}bands)"
    free = lambda p: f"({p}kind LIKE 'seed_free%')"
    whole = "('visual_community', 'layout_column', 'caption_anchor_visual')"

    def keeps(f: str, p: str) -> str:
        moved = " OR ".join(f"abs({f}{s} - {p}{s}) >= 8" for s in _BOXES)
        return f"(NOT {free(f)} AND {f}kind IN ('image_seed', 'captioned_image_seed') AND len({f}sources) = 1 AND len({p}sources) > 1 AND list_contains({p}sources, {f}sources[1]) AND {p}raster_ids = [{f}sources[1]] AND ({moved}))"

    def scoped(f: str, p: str) -> str:
        return f"({p}multi AND NOT {f}multi AND len({f}captions) = 1 AND (len({p}captions) = 0 OR list_has_all({p}captions, {f}captions)) AND {cover} >= 0.9)"

    def compact(f: str, p: str) -> str:
        rich = f"(CASE WHEN {visuals(p)} > 0 THEN {visuals(p)} / ({visuals(p)} + 3.0) ELSE 0.0 END)"
        return f"({f}kind = 'seed_free_compact_visual' AND CASE WHEN {p}kind = 'caption_anchor_visual' THEN least(1.0, {f}score / {p}score) + (1 - {rich}) * 0.42::DOUBLE >= 0.62::DOUBLE ELSE {p}kind IN {images} END AND {inter} / {ar(p)} >= 0.82::DOUBLE AND {ar(f)} / {ar(p)} <= 7 AND {visuals(f)} >= 2)"

    def full(f: str, p: str) -> str:
        layout = f"({f}kind = 'visual_community' AND {p}kind = 'layout_column' AND len({f}captions) = 1 AND {f}captions = {p}captions AND {cover} >= 0.9 AND {ar(f)} / {ar(p)} <= 6 AND ({f}members > {p}members OR {ar(f)} / {ar(p)} >= 1.15::DOUBLE))"
        plain = f"({inter} / greatest({ar(p)}, 1.0) >= 0.9 AND {ar(f)} / greatest({ar(p)}, 1.0) <= 8 AND {f}kind IN {whole} AND {p}kind NOT IN {whole})"
        others = f"({f}vectors + {f}borders + {f}bands)"
        border = f"({ar(f)} / {ar(p)} <= 6 AND {f}rasters >= 2 AND {f}borders + {f}vectors >= 2 AND {visuals(f)} >= greatest(4, {visuals(p)} + 3))"
        local = f"({inter} / {ar(p)} >= 0.9 AND CASE WHEN {p}kind = 'border' THEN {border} ELSE {p}kind IN {images} AND {ar(f)} / {ar(p)} <= 9 AND {f}rasters >= 1 AND {others} >= 2 END)"
        return f"(NOT {f}multi AND CASE WHEN {f}kind = 'visual_community' THEN {local} OR (len({f}captions) > 0 AND ({layout} OR {plain})) ELSE {layout} OR {plain} END)"

    return f"""CASE WHEN NOT ({iou_sql(a, b)} > 0.8 OR {cover} > 0.9) THEN 'both' WHEN {keeps(b, a)} THEN 'both' WHEN {scoped(b, a)} THEN 'displaces' WHEN {scoped(a, b)} THEN 'suppressed' WHEN {compact(b, a)} THEN 'displaces' WHEN {compact(a, b)} THEN 'suppressed'
 WHEN {full(b, a)} THEN CASE WHEN {keeps(a, b)} THEN 'both' ELSE 'displaces' END ELSE 'suppressed' END"""


_SUBSUMED = f"(b.kind LIKE 'seed_free%' AND a.kind NOT LIKE 'seed_free%' AND (a.kind IN ('image_cluster', 'image_seed', 'captioned_image_seed') OR {inter_sql('a.', 'b.')} / greatest({area_sql('b.')}, 1.0) >= 0.88::DOUBLE) AND list_has_all(a.atoms, b.atoms))"


@query(f"{_IT}, j AS (SELECT a.page_idx, a.ord AS a, b.ord AS b, {_verdict_sql('a.', 'b.')} AS verdict, {_SUBSUMED} AS subsumed FROM it a JOIN it b ON a.page_idx = b.page_idx AND a.ord < b.ord WHERE {inter_sql('a.', 'b.')} > 0) SELECT * FROM j WHERE verdict <> 'both' OR subsumed")
def closure_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of overlapping candidates with what happens to them, candidates made of the elements of both systems."""
    from pagefold.operators.ranking import rivals
    from pagefold.sources.layouts import predictions

    a = stored_atoms(spark, d)
    both = a.select("page_idx", "ord", *_BOXES, "xref").unionByName(predictions(spark, d, a).select("page_idx", (F.col("ord") + 1000).alias("ord"), *_BOXES, (F.col("ord") % 5).cast("bigint").alias("xref")))
    x, o = F.col("xref").cast("int"), F.col("ord")
    kind = F.element_at(F.array(*[F.lit(k) for k in _EIGHT]), (x + o) % 8 + 1)
    items = both.select(
        "page_idx", o.alias("rank"), *_BOXES, kind.alias("kind"), F.when(kind.startswith("seed_free"), "seed_free").otherwise("panel_candidate").alias("provenance"), (x % 5).alias("members"), (x % 7 == 0).alias("multi"), (x % 5 == 0).alias("numbered"),
        F.when(x % 3 == 0, F.array(o % 2)).when(x % 3 == 1, F.array(x % 2)).otherwise(F.array().cast("array<int>")).alias("captions"), F.when(x % 2 == 0, F.array(o)).otherwise(F.array(o, o % 1000)).alias("sources"), F.array(o % 1000, x % 3).alias("atoms"), F.array(o % 1000).alias("raster_ids"),
        (x % 4).alias("rasters"), (x % 3).alias("vectors"), (x % 2).alias("borders"), (o % 2).alias("bands"), ((x % 10 + 1) / 10).alias("score"),
    )
    return rivals(items, WIDTH)
