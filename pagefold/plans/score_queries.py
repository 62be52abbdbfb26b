"""Queries of boundary and evidence scores over pairs of neighbouring boxes, each with its SQL.

The left box plays the selected, complete or base one, the right one the proposal; confidences, object scores, counts
and labels are made of the elements' numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions import geometry as g
from pagefold.functions import scores as s
from pagefold.operators.boxjoin import self_pairs
from pagefold.plans.layout_queries import BOX, WITH_ATOMS, gap_sql, round_sql
from pagefold.sources.layouts import stored_atoms

QUERIES: dict = {}
SQL: dict[str, str] = {}
A, B = "a_", "b_"
KEYS = ("page_idx", "a_ord", "b_ord")
STRATEGIES = ("support_bbox", "visual_atom_union", "compact_object_evidence", "raster_annotation_extent", "content_branch")
SOURCES = ("raster_pixel_content", "primitive_evidence_region", "raster_annotation_extent", "other")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return self_pairs(stored_atoms(spark, d).select(*BOX, "xref"), reach=24.0, where=g.gap(A, B) <= 24)


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{n} % {len(values)} + 1]"


def _rounded(df: DataFrame, columns: dict) -> DataFrame:
    """Scores to 6 digits; text and truth as they are."""
    return df.select(*KEYS, *[(F.round(c, 6) if numeric else c).alias(n) for n, (c, numeric) in columns.items()])


# SQL: the measures that all scores read, as columns of one table.
_M = f"""{WITH_ATOMS}, p AS (SELECT a.page_idx, a.ord AS a_ord, b.ord AS b_ord, a.xref AS ax, b.xref AS bx, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1
  FROM atoms a JOIN atoms b ON a.page_idx = b.page_idx AND a.ord < b.ord WHERE {gap_sql('a.', 'b.')} <= 24),
 q AS (SELECT *, ax1 - ax0 AS aw, ay1 - ay0 AS ah, bx1 - bx0 AS bw, by1 - by0 AS bh, least(ax1, bx1) - greatest(ax0, bx0) AS ox, least(ay1, by1) - greatest(ay0, by0) AS oy, ax % 10 / 10 AS conf, CAST(bx % 12 AS DOUBLE) AS obj, ax % 7 / 7 AS prop FROM p),
 m AS MATERIALIZED (SELECT *, aw * ah AS aa, bw * bh AS ba, greatest(ox, 0.0) * greatest(oy, 0.0) AS i, least(obj, 10.0) / 10 AS strong,
  (bx0 - ax0) / aw AS l, (by0 - ay0) / ah AS t, (ax1 - bx1) / aw AS r, (ay1 - by1) / ah AS u, sqrt(greatest(-ox, 0.0) * greatest(-ox, 0.0) + greatest(-oy, 0.0) * greatest(-oy, 0.0)) AS gap FROM q),
 n AS MATERIALIZED (SELECT *, greatest(l, 0.0) + greatest(t, 0.0) + greatest(r, 0.0) + greatest(u, 0.0) AS loss, greatest(-l, 0.0) + greatest(-t, 0.0) + greatest(-r, 0.0) + greatest(-u, 0.0) AS over,
  CAST(l < 0 AS INT) + CAST(t < 0 AS INT) + CAST(r < 0 AS INT) + CAST(u < 0 AS INT) AS sides, i / least(aa, ba) AS cover FROM m)"""


def _select(columns: dict[str, tuple[str, bool]], source: str = "n") -> str:
    return f"SELECT page_idx, a_ord, b_ord, {', '.join(f'{round_sql(e, 6) if numeric else e} AS {n}' for n, (e, numeric) in columns.items())} FROM {source}"


def _inputs() -> dict[str, Column]:
    a, b = F.col("a_xref"), F.col("b_xref")
    return {"a": a, "b": b, "conf": a % 10 / 10, "obj": (b % 12).cast("double"), "prop": a % 7 / 7}


def _boundary(spark: SparkSession, d: str) -> DataFrame:
    x = _inputs()
    strategy = _pick(STRATEGIES, x["b"])
    component, content = x["b"] % 5 / 4, x["a"] % 6 / 5
    current = s.current_boundary_score(x["conf"], x["obj"], strategy)
    return _rounded(
        _pairs(spark, d),
        {
            "side_loss": (s.side_loss(A, B), True),
            "expansion": (s.external_expansion(A, B), True),
            "sides": (s.expanded_sides(A, B), False),
            "many_sides": (s.multi_side_support(A, B), True),
            "in_budget": (s.within_budget(A, B), False),
            "current": (current, True),
            "calibrated": (s.calibrated_boundary_score(A, B, x["conf"], x["obj"], x["prop"], strategy, component, content), True),
            "base_boundary": (s.base_boundary_score(x["conf"], x["obj"], strategy), True),
            "extent": (s.annotation_extent_score(A, B, x["prop"], (x["a"] % 4).cast("double"), (x["b"] * 50).cast("double"), F.lit(0.1)), True),
            "complete": (s.complete_boundary_score(x["conf"], x["obj"]), True),
        },
    )


_STRATEGY = _pick_sql(STRATEGIES, "bx")
_CURRENT = f"1.0 + conf * 0.75::DOUBLE + strong * 0.25::DOUBLE + CASE {_STRATEGY} WHEN 'compact_object_evidence' THEN 0.25 WHEN 'raster_annotation_extent' THEN 0.2 ELSE 0.0 END"
QUERIES["boundary_scores"] = _boundary
SQL["boundary_scores"] = _M + " " + _select(
    {
        "side_loss": ("loss", True),
        "expansion": ("over", True),
        "sides": ("sides", False),
        "many_sides": ("greatest(sides - 1, 0) / (sides + 2)", True),
        "in_budget": ("ba / aa <= 1.65 AND bw / aw <= 1.75 AND bh / ah <= 1.75", False),
        "current": (_CURRENT, True),
        "calibrated": (
            f"""0.85::DOUBLE + prop * 0.8::DOUBLE + conf * 0.35::DOUBLE + strong * 0.2::DOUBLE + CASE {_STRATEGY} WHEN 'visual_atom_union' THEN 0.25 WHEN 'support_bbox' THEN 0.05 ELSE 0.1 END
 + (greatest(1 - ba / aa, 0.0) * 1.35::DOUBLE + i / aa * 0.35::DOUBLE + i / ba * 0.25::DOUBLE) - (loss * 1.4::DOUBLE + over * 1.8::DOUBLE + greatest(ba / aa - 1, 0.0) * 2.5::DOUBLE)
 - (greatest(0.7::DOUBLE - i / aa, 0.0) * 2.2::DOUBLE + greatest(0.82::DOUBLE - bx % 5 / 4, 0.0) * 8.0 + greatest(0.94::DOUBLE - ax % 6 / 5, 0.0) * 18.0)""",
            True,
        ),
        "base_boundary": (f"1.0 + conf * 0.55::DOUBLE + strong * 0.25::DOUBLE + CASE WHEN {_STRATEGY} = 'compact_object_evidence' THEN conf * 0.2::DOUBLE ELSE 0.0 END", True),
        "extent": ("2.05::DOUBLE + prop + 0.25::DOUBLE * (ax % 4 / (ax % 4 + 3)) + 1.9::DOUBLE * (greatest(sides - 1, 0) / (sides + 2)) + 0.45::DOUBLE * (aa / ba) - 0.75::DOUBLE * greatest(ba / aa - 1, 0.0) - 0.55::DOUBLE * (bx * 50 / aa) - 0.5::DOUBLE * over - 0.1::DOUBLE", True),
        "complete": ("1.0 + conf * 0.8::DOUBLE + strong * 0.5::DOUBLE", True),
    }
)


def _trimming(spark: SparkSession, d: str) -> DataFrame:
    x = _inputs()
    span_w, span_h = x["a"] % 4 / 4, x["b"] % 3 / 2
    pairs = _pairs(spark, d)
    moved = s.axis_trimmed(A, B, span_w, span_h)
    pairs = pairs.withColumns({f"t_{k}": v for k, v in moved.items()})
    score = s.axis_trimmed_score(A, "t_", F.col("t_x_weight"), F.col("t_y_weight"), x["conf"], x["obj"], F.lit(1.5))
    return _rounded(pairs.where("t_x_weight > 0 OR t_y_weight > 0"), {**{k: (F.col(f"t_{k}"), True) for k in moved}, "score": (score, True)})


def _weight_sql(first: str, last: str, span: str) -> str:
    f, e = f"greatest({first}, 0.0)", f"greatest({last}, 0.0)"
    balance = f"CASE WHEN greatest({f}, {e}) > 0 THEN least({f}, {e}) / greatest({f}, {e}) ELSE 0.0 END"
    return f"least(0.92::DOUBLE, sqrt({f} + {e}) * ({balance}) * (CASE WHEN {span} > 0 THEN least(1.0, {span} / 0.75::DOUBLE) ELSE 1.0 END) * greatest(least(1.0, 1 - greatest({f} + {e} - 0.24::DOUBLE, 0.0) / 0.12::DOUBLE), 0.0) * 1.9::DOUBLE)"


QUERIES["trimmed_proposals"] = _trimming
SQL["trimmed_proposals"] = (
    _M
    + f""", w AS (SELECT *, {_weight_sql('l', 'r', 'ax % 4 / 4')} AS wx, {_weight_sql('t', 'u', 'bx % 3 / 2')} AS wy FROM n),
 v AS (SELECT *, ax0 + greatest(bx0 - ax0, 0.0) * wx AS px0, ay0 + greatest(by0 - ay0, 0.0) * wy AS py0, ax1 - greatest(ax1 - bx1, 0.0) * wx AS px1, ay1 - greatest(ay1 - by1, 0.0) * wy AS py1 FROM w WHERE wx > 0 OR wy > 0),
 z AS (SELECT *, greatest((px1 - px0) * (py1 - py0), 1.0) AS pa, greatest(least(px1, ax1) - greatest(px0, ax0), 0.0) * greatest(least(py1, ay1) - greatest(py0, ay0), 0.0) AS pi, greatest(wx, wy) AS best FROM v) """
    + _select(
        {
            "x0": ("px0", True), "y0": ("py0", True), "x1": ("px1", True), "y1": ("py1", True), "x_weight": ("wx", True), "y_weight": ("wy", True),
            "score": ("1.5 + -0.22::DOUBLE + conf * 0.16::DOUBLE + strong * 0.06::DOUBLE + greatest(1 - pa / aa, 0.0) * 0.55::DOUBLE + ((best + (wx + wy) * 0.25::DOUBLE) * 0.85::DOUBLE + pi / aa * 0.08::DOUBLE) - greatest(wx - wy, 0.0) * 1.35::DOUBLE - greatest(0.48::DOUBLE - best, 0.0) * 4.8::DOUBLE", True),
        },
        "z",
    )
)


def _content(spark: SparkSession, d: str) -> DataFrame:
    x = _inputs()
    a, b = x["a"], x["b"]
    richness = s.evidence_richness(primitives=a % 6, kinds=b % 3, groups=a % 3, backgrounds=b % 2)
    active = F.when(b % 4 != 0, b % 9 / 9)
    ratio = g.area(B) / g.area(A)
    authority = s.content_authority(a % 5 == 0, b % 6 == 0, _pick(SOURCES, a), active, x["prop"] - 0.6, _pick(("raster_content_branch", "other"), b), a % 3 == 0, ratio, richness)
    pairs = _pairs(spark, d).withColumns({"_rich": richness, "_auth": authority}).withColumns({"_repl": s.content_replacement_score(A, B, x["conf"], x["obj"], F.col("_auth")), "_whole": s.complete_boundary_score(b % 10 / 10, (a % 12).cast("double"))})
    return _rounded(
        pairs,
        {
            "richness": (F.col("_rich"), True),
            "authority": (F.col("_auth"), True),
            "replacement": (F.col("_repl"), True),
            "fragmentary": (s.is_fragmentary(A, B), False),
            "replaces": (s.content_can_replace(A, B, F.col("_repl"), F.col("_whole"), b % 2 == 0), False),
            "local_replaces": (s.local_can_replace(A, B, F.greatest(x["conf"], F.lit(0.85)), a % 2 == 0), False),
            "context": (s.contextual_visual_score(A, B, x["conf"], x["obj"], a % 5, b % 2 == 1), True),
            "group_score": (s.raster_group_score(A, B, x["conf"], x["obj"], a % 2 == 1), True),
            "group_alone": (s.raster_group_score(A, B), True),
            "same_row": (s.same_row_affinity(A, B), True),
            "disagreement": (s.disagreement(a % 9, b % 9, x["conf"], x["prop"], x["obj"] / 12), True),
        },
    )


_SOFT = "CASE WHEN {0} > 0 THEN {0} / ({0} + {1}) ELSE 0.0 END"
_RICH = " + ".join(["0.0", *[f"({_SOFT.format(c, p)}) * {w}::DOUBLE" for c, w, p in (("(ax % 6)", 0.35, "4.0"), ("(bx % 3)", 0.25, "2.0"), ("(ax % 3)", 0.2, "2.0"), ("(bx % 2)", 0.15, "2.0"))]])
_DENSE = "least(greatest((CASE WHEN bx % 4 <> 0 THEN bx % 9 / 9 ELSE 0.0 END - 0.35::DOUBLE) / (0.6::DOUBLE - 0.35::DOUBLE), 0.0), 1.0)"
_AUTHORITY = f"""CASE WHEN ax % 5 = 0 THEN 1.8::DOUBLE ELSE 0.0 END + CASE WHEN bx % 6 = 0 THEN 1.4::DOUBLE ELSE 0.0 END + CASE WHEN ax % 4 = 1 THEN 0.2::DOUBLE ELSE 0.0 END
 + CASE WHEN ax % 4 = 0 THEN {_DENSE} * (0.15::DOUBLE + least(0.35::DOUBLE, greatest(-(prop - 0.6::DOUBLE), 0.0) * 2.5::DOUBLE)) - CASE WHEN bx % 4 <> 0 THEN (1 - {_DENSE}) * 0.18::DOUBLE ELSE 0.0 END ELSE 0.0 END
 + CASE WHEN bx % 2 = 0 THEN 0.6::DOUBLE ELSE 0.0 END + CASE WHEN ax % 3 = 0 THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN ba / aa >= 0.9::DOUBLE THEN 0.25::DOUBLE ELSE 0.0 END + rich"""
_FRAGMENT = "(ba / aa < 0.58::DOUBLE AND loss >= 0.42::DOUBLE AND ((bw / aw < 0.62::DOUBLE AND bh / ah >= 0.72::DOUBLE) OR (bh / ah < 0.62::DOUBLE AND bw / aw >= 0.72::DOUBLE)))"
QUERIES["content_scores"] = _content
SQL["content_scores"] = (
    _M
    + f""", h AS (SELECT *, {_RICH} AS rich FROM n), k AS (SELECT *, {_AUTHORITY} AS auth FROM h),
 z AS (SELECT *, conf + strong * 1.4::DOUBLE + auth + greatest(1 - ba / aa, 0.0) * 0.4::DOUBLE + cover * 0.2::DOUBLE - (loss * greatest(0.8::DOUBLE, 3.3::DOUBLE - auth) + over * greatest(0.45::DOUBLE, 2.2::DOUBLE - auth * 0.45::DOUBLE)) - greatest(ba / aa - 1, 0.0) * greatest(0.1::DOUBLE, 0.7::DOUBLE - auth * 0.15::DOUBLE) - greatest(1 - cover, 0.0) * 1.5::DOUBLE AS repl FROM k) """
    + _select(
        {
            "richness": ("rich", True), "authority": ("auth", True), "replacement": ("repl", True), "fragmentary": (_FRAGMENT, False),
            "replaces": (f"NOT (bx % 2 = 0 AND {_FRAGMENT}) AND repl > 1.0 + bx % 10 / 10 * 0.8::DOUBLE + least(CAST(ax % 12 AS DOUBLE), 10.0) / 10 * 0.5::DOUBLE", False),
            "local_replaces": ("ba / aa >= 0.12::DOUBLE AND greatest(conf, 0.85::DOUBLE) >= 0.9::DOUBLE AND ax % 2 = 0 AND cover >= 0.8::DOUBLE", False),
            "context": (f"conf + least(obj, 6.0) * 0.025::DOUBLE + least(1.0, i / aa) * 0.25::DOUBLE + ({_SOFT.format('(ax % 5)', '2.0')}) * 0.22::DOUBLE + CASE WHEN bx % 2 = 1 THEN 0.12::DOUBLE ELSE 0.0 END - greatest(ba / aa - 1.85::DOUBLE, 0.0) * 0.22::DOUBLE", True),
            "group_score": ("0.55::DOUBLE + (i / aa * 0.8::DOUBLE + cover * 0.2::DOUBLE) + greatest(1 - ba / aa, 0.0) * 0.4::DOUBLE + conf * 0.5::DOUBLE + strong * 0.8::DOUBLE + CASE WHEN ax % 2 = 1 THEN 0.15::DOUBLE ELSE 0.0 END", True),
            "group_alone": ("0.65::DOUBLE + (i / aa * 0.8::DOUBLE + cover * 0.2::DOUBLE)", True),
            "same_row": ("greatest(greatest(oy, 0.0) / least(ah, bh) * (least(ah, bh) / greatest(ah, bh)) - greatest(CASE WHEN ax0 <= bx0 THEN bx0 - ax1 ELSE ax0 - bx1 END, 0.0) / least(aw, bw), 0.0)", True),
            "disagreement": ("abs(conf - prop) * 100 + abs(ax % 9 - bx % 9) * 2 + (1 - obj / 12) * 50", True),
        },
        "z",
    )
)


def _notes(spark: SparkSession, d: str) -> DataFrame:
    x = _inputs()
    semantic = _semantic(x["b"])
    spans = s.touching_spans(A, B)
    return _rounded(
        _pairs(spark, d),
        {"owner": (s.owner_affinity(A, B), True), "local": (s.local_support(A, B, semantic), True), **{f"touch_{k}": (v, True) for k, v in spans.items()}, "unsupported": (s.unsupported_trim(A, B, spans), True), **{f"trim_{k}": (v, True) for k, v in s.trims(A, B).items()}},
    )


def _semantic(n: Column) -> Column:
    return F.when(n % 4 == 0, 0.0).when(n % 4 == 1, 0.35).when(n % 4 == 2, 0.6).otherwise(0.95)


_SEM = "CASE bx % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.35::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.95::DOUBLE END"
_IN_X, _IN_Y = "((bx0 + bx1) / 2 BETWEEN ax0 AND ax1)", "((by0 + by1) / 2 BETWEEN ay0 AND ay1)"
_DX, _DY = "greatest(-ox, 0.0)", "greatest(-oy, 0.0)"
_SH = "(i / ba)"
_NEAR = "greatest(4.0, least(aw, ah) * 0.08::DOUBLE)"
_TOUCH = {"left": f"CASE WHEN least(abs(bx0 - ax0), abs(bx1 - ax0)) <= {_NEAR} THEN greatest(oy, 0.0) / ah ELSE 0.0 END", "right": f"CASE WHEN least(abs(bx0 - ax1), abs(bx1 - ax1)) <= {_NEAR} THEN greatest(oy, 0.0) / ah ELSE 0.0 END", "top": f"CASE WHEN least(abs(by0 - ay0), abs(by1 - ay0)) <= {_NEAR} THEN greatest(ox, 0.0) / aw ELSE 0.0 END", "bottom": f"CASE WHEN least(abs(by0 - ay1), abs(by1 - ay1)) <= {_NEAR} THEN greatest(ox, 0.0) / aw ELSE 0.0 END"}
QUERIES["annotation_supports"] = _notes
SQL["annotation_supports"] = _M + " " + _select(
    {
        "owner": ("1 / (1 + gap / 8.0) + greatest(greatest(ox, 0.0) / least(aw, bw), greatest(oy, 0.0) / least(ah, bh)) * (1 / (1 + gap / 8.0))", True),
        "local": (
            f"""CASE WHEN {_SEM} <= 0 THEN 0.0 ELSE {_SEM} * 0.8::DOUBLE + {_SH} * 0.6::DOUBLE + 1 / (1 + gap / least(aw, ah)) * 0.4::DOUBLE + CASE WHEN {_IN_X} AND {_IN_Y} THEN 0.25 ELSE 0.0 END + least(1.0, ba / aa) * 0.1::DOUBLE
 - (1 - least(1.0, {_SH})) * (least(2.0, bw / aw) + least(2.0, bh / ah)) * (0.35::DOUBLE + CASE WHEN {_IN_X} AND {_IN_Y} THEN 0.0 WHEN {_IN_X} OR {_IN_Y} THEN 0.45::DOUBLE - 0.32::DOUBLE ELSE 0.45::DOUBLE END)
 - (CASE WHEN {_IN_X} THEN 0.0 ELSE least(2.0, bw / aw) * {_DX} / aw END + CASE WHEN {_IN_Y} THEN 0.0 ELSE least(2.0, bh / ah) * {_DY} / ah END) * 3 - (CASE WHEN {_IN_X} THEN 0.0 ELSE {_DX} / aw END + CASE WHEN {_IN_Y} THEN 0.0 ELSE {_DY} / ah END) * 0.55::DOUBLE END""",
            True,
        ),
        **{f"touch_{k}": (v, True) for k, v in _TOUCH.items()},
        "unsupported": (" + ".join(f"greatest({c}, 0.0) * greatest(0.2::DOUBLE - ({_TOUCH[k]}), 0.0) / 0.2::DOUBLE" for k, c in (("left", "l"), ("top", "t"), ("right", "r"), ("bottom", "u"))), True),
        **{f"trim_{k}": (f"greatest({c}, 0.0)", True) for k, c in (("left", "l"), ("top", "t"), ("right", "r"), ("bottom", "u"))},
    }
)
