"""Queries of text dictionaries, annotation texts, element classes, evidence and panels, each with its SQL.

Text comes from the documents, boxes from the derived layouts, widened so that columns of bands and body text occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions import visuals as v
from pagefold.operators import annotations, panels, ranking
from pagefold.operators.evidence import has_reasons, marked, merged_reasons
from pagefold.plans.layout_queries import _BARRIER, WITH_ATOMS, area_sql, gap_sql, inter_sql, iou_sql, round_sql
from pagefold.plans.shared import stored
from pagefold.sources import textdict
from pagefold.sources.layouts import HEIGHT, WIDTH, atoms
from pagefold.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
BOX = ("x0", "y0", "x1", "y1")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Text dictionaries.

_WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _ends_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


_LABEL_SQL = r"(?i)^\s*(?:fig(?:ure)?\.?|图|圖)\s*\d+(?:\.\d+)*(?:-\d+)?[A-Za-z]?(?:\s|[:：.。)、\]-]|$)"
_BLOCKS_SQL = f"""blocks AS MATERIALIZED (SELECT doc_id AS page_idx, i - 1 AS blk, string_split(p, E'\\n') AS raw FROM (SELECT doc_id, unnest(string_split(text, E'\\n\\n')) AS p, generate_subscripts(string_split(text, E'\\n\\n'), 1) AS i FROM documents WHERE text IS NOT NULL)),
 lines AS MATERIALIZED (SELECT page_idx, blk, j - 1 AS j, t, {_ends_sql('t')} AS line FROM (SELECT page_idx, blk, unnest(raw) AS t, generate_subscripts(raw, 1) AS j FROM blocks WHERE blk % 7 <> 6))"""


@query(
    f"""WITH {_BLOCKS_SQL}, b AS (SELECT page_idx, blk, count(*) FILTER (line <> '') AS n, bool_and(regexp_matches(line, '{_LABEL_SQL}')) FILTER (line <> '') AS labels, string_agg(line, E'\\n' ORDER BY j) FILTER (line <> '') AS whole, least(max(length(t)) * 5.0, 520.0) AS w, count(*) AS rows FROM lines GROUP BY 1, 2),
 parted AS (SELECT page_idx, blk FROM b WHERE n >= 2 AND labels),
 e AS (SELECT page_idx, blk, 0 AS j, 40.0 AS x0, blk * 60.0 AS y0, 40.0 + w AS x1, blk * 60.0 + rows * 12.0 AS y1, whole AS text, false AS split, CAST(NULL AS INTEGER) AS line FROM b WHERE n > 0 AND NOT (n >= 2 AND labels)
 UNION ALL SELECT page_idx, blk, j, 40.0, blk * 60.0 + j * 12.0, 40.0 + least(length(t) * 5.0, 520.0), blk * 60.0 + j * 12.0 + 10.0, line, true, CAST(j AS INTEGER) FROM lines JOIN parted USING (page_idx, blk) WHERE line <> '')
 SELECT page_idx, CAST(row_number() OVER (PARTITION BY page_idx ORDER BY blk, j) AS INTEGER) AS ord, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, text, CAST(blk AS INTEGER) AS block_number, split, line FROM e"""
)
def text_atoms(spark: SparkSession, d: str) -> DataFrame:
    return textdict.text_atoms(textdict.payloads_of(table(spark, d, "documents"), "doc_id", "text"))


@query(
    f"""WITH {_BLOCKS_SQL}, s AS (SELECT page_idx, blk, j, 0 AS k, substr(t, 1, 10) AS t, length(t) % 3 + 9.0 AS size, 'Serif' AS font FROM lines WHERE t <> '' UNION ALL SELECT page_idx, blk, j, 1, substr(t, 11), 10.0, 'Sans' FROM lines WHERE length(t) > 10),
 z AS (SELECT page_idx, blk, size FROM (SELECT page_idx, blk, size, row_number() OVER (PARTITION BY page_idx, blk ORDER BY sum(length(t)) DESC, min(j * 2 + k)) AS n FROM s GROUP BY 1, 2, 3) WHERE n = 1),
 f AS (SELECT page_idx, blk, font FROM (SELECT page_idx, blk, font, row_number() OVER (PARTITION BY page_idx, blk ORDER BY sum(length(t)) DESC, min(j * 2 + k)) AS n FROM s GROUP BY 1, 2, 3) WHERE n = 1),
 q AS (SELECT page_idx, blk, sum((s.size - z.size) * (s.size - z.size) * length(t)) AS v, sum(length(t)) AS n FROM s JOIN z USING (page_idx, blk) GROUP BY 1, 2),
 b AS (SELECT page_idx, blk, row_number() OVER (PARTITION BY page_idx ORDER BY blk) AS block, count(*) AS rows, count(*) FILTER (line <> '') AS n, sum(length(line)) AS chars, string_agg(line, E'\\n' ORDER BY j) FILTER (line <> '') AS text, least(max(length(t)) * 5.0, 520.0) AS w, max(max(least(length(t) * 5.0, 520.0))) OVER (PARTITION BY page_idx) AS region FROM lines GROUP BY 1, 2)
 SELECT page_idx, CAST(block AS INTEGER) AS block, CAST(40 AS DOUBLE) AS x0, CAST(blk * 60 AS DOUBLE) AS y0, CAST(40 + w AS DOUBLE) AS x1, CAST(blk * 60 + rows * 12 AS DOUBLE) AS y1, text, CAST(z.size AS DOUBLE) AS dominant_font_size, f.font AS dominant_font_name, CAST(chars AS INTEGER) AS chars, {round_sql('CAST(q.v AS DOUBLE) / q.n', 6)} AS font_size_variance,
 CASE WHEN rows >= 2 THEN {round_sql('12 / CAST(z.size AS DOUBLE)')} ELSE 1.0 END AS line_spacing_ratio, {round_sql('greatest(CAST(w AS DOUBLE), 1.0) / (CASE WHEN region > 0 THEN CAST(region AS DOUBLE) ELSE 600.0 END)')} AS block_width_ratio, {round_sql('chars / (greatest(CAST(w AS DOUBLE), 1.0) * (rows * 12.0))', 6)} AS char_density,
 CAST(CASE WHEN chars * 2 % b.n = 0 AND (chars * 2 // b.n) % 2 = 1 THEN (chars // b.n) + (chars // b.n) % 2 ELSE round(chars / b.n) END AS BIGINT) AS avg_line_length, b.n = 1 AS is_single_line
 FROM b JOIN z USING (page_idx, blk) JOIN f USING (page_idx, blk) JOIN q USING (page_idx, blk) WHERE b.n > 0"""
)
def text_records(spark: SparkSession, d: str) -> DataFrame:
    return textdict.block_records(textdict.payloads_of(table(spark, d, "documents"), "doc_id", "text"), WIDTH)


# Annotation texts: every paragraph of every document.

_END = r"(?:[^\p{L}\p{N}_]|$)"
_START = r"(?:^|[^\p{L}\p{N}_])"
_UNIT = r"(regexp_matches(n, '\[[^\]]{1,28}\]|\d+(?:\.\d+)?\s*%|/[A-Za-z]') OR len(list_filter(regexp_extract_all(n, '\([A-Za-z0-9μµ°/%.\s-]{1,18}\)'), lambda x: regexp_matches(x, '[A-Za-zμµ°/%]'))) > 0)"
_DOUBLED = r"' ' || regexp_replace(n, '([^\p{L}\p{N}_])', '\1\1', 'g') || ' '"
_ANNOTATION_SQL = (
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, E'\\n\\n')) AS p, generate_subscripts(string_split(text, E'\\n\\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
 a AS (SELECT doc_id, i, p, {_ends_sql(f"regexp_replace(p, '{_WS}+', ' ', 'g')")} AS n, list_filter(list_transform(regexp_split_to_array(p, '[\\n\\r\\x{{b}}\\x{{c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_ends_sql('x')}), lambda x: x <> '') AS ls FROM p),
 b AS (SELECT *, array_to_string(ls, ' ') AS joined, regexp_extract_all(n, '[A-Za-z]+|\\d+(?:\\.\\d+)?') AS toks, regexp_replace(n, '{_WS}+', '', 'g') AS tight, length(n) AS len, len(ls) AS rows, coalesce(list_max(list_transform(ls, lambda x: length(x))), 0) AS widest, len(regexp_extract_all(n, '[\\x{{3400}}-\\x{{9fff}}]')) AS cjk FROM a),
 c AS (SELECT *, len(toks) AS words, len(list_filter(toks, lambda x: regexp_matches(x, '^[0-9]'))) AS nums, len <= 48 AND (regexp_matches(n, '(?i)[αβγδεθκλμρσφψωξ]') OR len(regexp_extract_all({_DOUBLED}, '[^\\p{{L}}\\p{{N}}_][xyz](?:[A-Z]{{1,3}})?[^\\p{{L}}\\p{{N}}_]')) >= 2) AS variable,
  regexp_matches(n, '(?i)^(?:{'|'.join(annotations.TABLE_WORDS)}){_END}') OR regexp_matches(n, '(?i)^Statement:[\\p{{L}}\\p{{N}}_]') AS table_start, regexp_matches(n, '^\\d{{1,4}}\\s*/\\s*\\d{{1,4}}$') AS page_number FROM b),
 e AS (SELECT *, CASE WHEN words > 0 THEN nums / words ELSE 0.0 END AS share, rows BETWEEN 3 AND 8 AND widest <= 42 AND words BETWEEN 3 AND 24 AND CASE WHEN words > 0 THEN nums / words ELSE 0.0 END <= 0.4 AS legend, len <= 90 AND words <= 14 AND {_UNIT} AS unit,
  cjk BETWEEN 2 AND 14 AND regexp_matches(tight, '{annotations.FORM_LABEL}') AS form FROM c),
 f AS (SELECT *, n <> '' AND len <= 180 AND NOT page_number AND NOT table_start AND (variable OR (words > 0 AND ((nums >= 2 AND words <= 18 AND share >= 0.35) OR unit))) AS flat,
  n <> '' AND len <= 180 AND NOT page_number AND NOT table_start AND (variable OR legend OR (words > 0 AND ((nums >= 2 AND words <= 18 AND share >= 0.35) OR (rows >= 2 AND words <= 16 AND nums >= 2) OR unit OR (rows BETWEEN 2 AND 6 AND words <= 18 AND widest <= 48)))) AS axis,
  cjk > 0 AND (form OR (regexp_matches(n, '{annotations.NUMBERED_CJK}') AND cjk >= 10) OR (regexp_matches(n, '{annotations.LISTED_CJK}') AND cjk >= 8) OR (regexp_matches(tight, '{annotations.FORM_WORDS}') AND cjk >= 4 AND regexp_matches(n, '[:：]|^[（(]?\\d'))) AS cjk_table FROM e),
 g AS (SELECT *, n <> '' AND NOT axis AND (table_start OR cjk_table OR regexp_matches(n, '(?i){_START}(?:{'|'.join(annotations.SYSTEM_NAMES)}){_END}') OR (words >= 6 AND share >= 0.3)) AS table_cell, cjk > 0 AND (form OR cjk_table OR (cjk >= 18 AND regexp_matches(tight, '{annotations.CJK_STOPS}')) OR (cjk >= 24 AND rows <= 2)) AS cjk_body,
  cjk > 0 AND (form OR cjk_table OR (cjk >= 18 AND regexp_matches(tight, '{annotations.CJK_STOPS}')) OR cjk >= 24) AS cjk_line, regexp_matches(n, '(?i)^\\s*(?:fig(?:ure)?\\.?|图|圖)\\s*[\\divxlcdm]+[.:：、]?') OR regexp_matches(n, '(?i)^\\s*(?:table|tab\\.|表)\\s*[\\divxlcdm]+(?:[.:：、]|{_END})') AS caption,
  regexp_matches(joined, '{annotations.MATH.replace('(?iu)', '(?i)')}') AND (words >= 6 OR length(joined) >= 42) AS mathy, regexp_matches(n, '{annotations.SECTION}') AS section FROM f),
 h AS (SELECT *, caption OR page_number OR regexp_matches(n, '{annotations.AUTHOR_HEADER}') OR (regexp_matches(joined, '{annotations.EQUATION_END}') AND regexp_matches(joined, '{annotations.EQUATION_SIGN}')) OR (NOT flat AND mathy) OR section OR (NOT axis AND (cjk_line OR regexp_matches(n, '{annotations.HEADING}') OR table_cell OR words >= 8)) AS excluded,
  n <> '' AND ((len <= 36 AND regexp_matches(n, '{annotations.ELLIPSIS}')) OR axis OR regexp_matches(n, '{annotations.LETTER}') OR regexp_matches(n, '{annotations.NUMBER}') OR variable OR (regexp_matches(tight, '^[\\x{{3400}}-\\x{{9fff}}]{{2,8}}$') AND regexp_matches(tight, '{annotations.DIAGRAM_LABEL}')) OR (len <= 90 AND words BETWEEN 1 AND 6)) AS label,
  words BETWEEN 1 AND 24 AND nums >= 2 AND words <= 18 AND (rows >= 2 OR share >= 0.35) AS scale, rows BETWEEN 2 AND 6 AND widest <= 48 AND words BETWEEN 3 AND 18 AND (len(list_filter(ls, lambda x: regexp_matches(x, '{annotations.ENUMERATED}'))) > 0 OR nums >= 1) AS block FROM g)
 SELECT doc_id, CAST(i - 1 AS INTEGER) AS paragraph, axis, table_cell, excluded, cjk_body, label, label AND NOT excluded AND NOT cjk_body AS annotates,
 CASE WHEN n = '' OR caption THEN 0.0 WHEN section THEN 0.12 WHEN regexp_matches(n, '(?i){_START}(?:JOURNAL|PROCEEDINGS|TRANSACTIONS){_END}|{_START}VOL\\.[\\p{{L}}\\p{{N}}_]') OR (NOT (variable OR (words BETWEEN 1 AND 18 AND nums >= 2 AND share >= 0.35) OR unit) AND mathy) THEN 0.0
  WHEN variable OR scale OR unit OR block THEN 0.95 WHEN legend THEN 0.75 WHEN rows >= 2 AND words <= 18 AND nums >= 2 THEN 0.9 WHEN regexp_matches(n, '{annotations.NUMBER}') THEN 0.85 WHEN regexp_matches(n, '{annotations.LETTER}') THEN 0.75 WHEN words <= 2 THEN 0.6 WHEN words <= 6 THEN 0.35 WHEN words <= 8 THEN 0.18 ELSE 0.0 END AS support FROM h"""
)


@query(_ANNOTATION_SQL)
def annotation_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("paragraph", "p"))
    return annotations.annotation_rules(parts, "p").drop("p")


# Elements and evidence.

_RICH = f"""{WITH_ATOMS}, rich AS MATERIALIZED (SELECT page_idx, ord, kind, x0, y0, CASE WHEN kind = 'text_block' AND xref % 3 = 0 THEN x0 + 280 ELSE x1 END AS x1, y1, CASE WHEN xref % 2 = 0 THEN text || E'\\n' || text ELSE text END AS text, CASE WHEN xref % 2 = 1 THEN 'xref' ELSE 'text_dict' END AS source, xref % 7 = 0 AS clipped FROM atoms
 UNION ALL SELECT page_idx, ord + 100, 'color_band', x0 + 2, y0 + 150, x1 + 2, y1 + 150, NULL, 'made', false FROM atoms WHERE kind = 'color_band' AND xref % 4 = 0
 UNION ALL SELECT page_idx, ord + 200, 'vector_cluster', x0 + 5, y1 + 10, x1 - 5, y0 + 140, NULL, 'made', false FROM atoms WHERE kind = 'color_band' AND xref % 4 = 0 AND y0 + 140 > y1 + 10)"""


def rich_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The derived elements, some texts doubled or widened, with a second band and a background under some bands."""
    x, text = F.col("xref"), F.col("kind") == "text_block"
    base = stored(atoms(spark, d), "atoms")
    own = base.select(
        "page_idx", "ord", "kind", "x0", "y0", F.when(text & (x % 3 == 0), F.col("x0") + 280).otherwise(F.col("x1")).alias("x1"), "y1",
        F.when(x % 2 == 0, F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"), F.when(x % 2 == 1, "xref").otherwise("text_dict").alias("source"), (x % 7 == 0).alias("clipped"),
    )
    bands = base.where((F.col("kind") == "color_band") & (x % 4 == 0))
    made = lambda df, by, kind, box: df.select("page_idx", (F.col("ord") + by).alias("ord"), F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(box, BOX, strict=True)], F.lit(None).cast("string").alias("text"), F.lit("made").alias("source"), F.lit(False).alias("clipped"))
    c = F.col
    second = made(bands, 100, "color_band", (c("x0") + 2, c("y0") + 150, c("x1") + 2, c("y1") + 150))
    behind = made(bands.where("y0 + 140 > y1 + 10"), 200, "vector_cluster", (c("x0") + 5, c("y1") + 10, c("x1") - 5, c("y0") + 140))
    return stored(reduce(DataFrame.unionByName, [own, second, behind]), "rich")


def _clip(c: str, m: int) -> str:
    return f"least(greatest({c}, 0.0), {m}.0)"


def _visible(w: int, h: int) -> str:
    return f"((greatest({_clip('x1', w)} - {_clip('x0', w)}, 0.0)) * (greatest({_clip('y1', h)} - {_clip('y0', h)}, 0.0)))"


def _edges(w: int, h: int) -> str:
    return f"(CAST({_clip('x0', w)} <= 12 AS INT) + CAST({_clip('y0', h)} <= 12 AS INT) + CAST({_clip('x1', w)} >= {w} - 12 AS INT) + CAST({_clip('y1', h)} >= {h} - 12 AS INT))"


def _flags_sql(w: int, h: int) -> dict[str, str]:
    seen, page = _visible(w, h), w * h
    background = f"({seen} > 0 AND ({seen} / {page} >= 0.75 OR {_edges(w, h)} >= 3))"
    body = f"(kind = 'text_block' AND text IS NOT NULL AND (x1 - x0) / {w} >= 0.4 AND length(text) - length(replace(text, E'\\n', '')) + 1 >= 2 AND length(trim(text, E' \\n')) >= 20)"
    edge = f"(CASE kind WHEN 'color_band' THEN y0 <= 12 OR y1 >= {h} - 12 WHEN 'raster_image' THEN y0 <= {h} * 0.08::DOUBLE OR y1 >= {h} * 0.95::DOUBLE ELSE false END AND {area_sql('')} / {page} <= 0.01)"
    off = f"(kind IN ('vector_cluster', 'color_band', 'panel_border') AND ({seen} / {area_sql('')} < 0.85 OR greatest(0.0, -x0, x1 - {w}) > greatest(12.0, {w} * 0.025) OR greatest(0.0, -y0, y1 - {h}) > greatest(12.0, {h} * 0.025)))"
    visual = f"(kind IN ('vector_cluster', 'raster_image', 'color_band', 'panel_border') AND NOT {body} AND NOT {edge} AND NOT {off} AND NOT (kind = 'vector_cluster' AND {background}))"
    vw, vh = f"({_clip('x1', w)} - {_clip('x0', w)})", f"({_clip('y1', h)} - {_clip('y0', h)})"
    hero = f"(kind IN ('vector_cluster', 'raster_image', 'color_band') AND NOT {background} AND {seen} > 0 AND ({seen} / {page} >= 0.25 OR ({vw} / {w} >= 0.45 AND {vh} / {h} >= 0.18 AND {seen} / {page} >= 0.12)))"
    large = f"((x1 - x0 >= 180 AND y1 - y0 >= 180 AND {area_sql('')} >= 50000) OR ((x1 - x0) / {w} >= 0.45 AND (y1 - y0) / {h} >= 0.15 AND {area_sql('')} / {page} >= 0.08))"
    spans = f"({seen} / {page} >= 0.75 OR CAST(x0 <= 12 AS INT) + CAST(y0 <= 12 AS INT) + CAST(x1 >= {w} - 12 AS INT) + CAST(y1 >= {h} - 12 AS INT) >= 3)"
    over = f"(x0 < -greatest(12.0, {w} * 0.025) OR x1 > {w} + greatest(12.0, {w} * 0.025) OR y0 < -greatest(12.0, {h} * 0.025) OR y1 > {h} + greatest(12.0, {h} * 0.025))"
    tiny = f"({area_sql('')} / {page} <= 0.01 AND (y0 <= {h} * 0.08::DOUBLE OR y1 >= {h} * 0.95::DOUBLE))"
    return {"body_text": body, "edge_boilerplate": edge, "offpage": off, "background": background, "hidden_background": f"CASE WHEN {seen} <= 0 THEN true ELSE {background} END", "visual": visual, "hero": hero, "large_image": large, "spans_page": spans, "hangs_over": over, "edge_tiny": tiny}


@query(f"{_RICH} SELECT page_idx, ord, {', '.join(f'{e} AS {n}' for n, e in _flags_sql(480, 640).items())} FROM rich")
def element_classes(spark: SparkSession, d: str) -> DataFrame:
    k, t, w, h = F.col("kind"), F.col("text"), 480.0, 640.0
    no = lambda c: F.coalesce(c, F.lit(False))
    flags = {"body_text": no(v.is_body_text(k, t, "", w)), "edge_boilerplate": v.is_edge_boilerplate(k, "", w, h), "offpage": v.is_offpage(k, "", w, h), "background": v.is_background("", w, h), "hidden_background": v.is_background("", w, h, True), "visual": v.is_visual(k, t, "", w, h), "hero": v.is_hero(k, "", w, h), "large_image": v.is_large_image("", w, h), "spans_page": v.spans_page("", w, h), "hangs_over": v.hangs_over("", w, h), "edge_tiny": v.is_edge_tiny("", w, h)}
    return rich_atoms(spark, d).select("page_idx", "ord", *[c.alias(n) for n, c in flags.items()])


_PEER = {
    "meet": "((oy > 0 AND -ox <= 40) OR (ox > 0 AND -oy <= 40))",
    "nested": "(i > 0 AND i / least(aa, ba) >= 0.86::DOUBLE AND greatest(aa, ba) / least(aa, ba) >= 1.18::DOUBLE)",
    "subordinate": "(ba < aa * 0.16::DOUBLE AND gap <= greatest(4.0, least(aw, ah) * 0.12::DOUBLE) AND greatest(greatest(ox, 0.0) / least(aw, bw), greatest(oy, 0.0) / least(ah, bh)) >= 0.45::DOUBLE)",
    "near": """(i > 0 OR (greatest(ox, 0.0) / least(aw, bw) >= 0.35::DOUBLE AND (a.y0 - b.y1 BETWEEN 0 AND most OR b.y0 - a.y1 BETWEEN 0 AND most)) OR (greatest(oy, 0.0) / least(ah, bh) >= 0.35::DOUBLE AND (a.x0 - b.x1 BETWEEN 0 AND most OR b.x0 - a.x1 BETWEEN 0 AND most)))""",
}


@query(
    f"""{WITH_ATOMS}, m AS (SELECT a.page_idx, a.ord AS a_ord, b.ord AS b_ord, a, b, a.x1 - a.x0 AS aw, a.y1 - a.y0 AS ah, b.x1 - b.x0 AS bw, b.y1 - b.y0 AS bh, {area_sql('a.')} AS aa, {area_sql('b.')} AS ba, {inter_sql('a.', 'b.')} AS i, {gap_sql('a.', 'b.')} AS gap,
 least(a.x1, b.x1) - greatest(a.x0, b.x0) AS ox, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS oy, greatest(16.0, least(36.0, least(a.x1 - a.x0, a.y1 - a.y0) * 0.16::DOUBLE)) AS most FROM atoms a JOIN atoms b ON a.page_idx = b.page_idx AND a.ord <> b.ord WHERE {gap_sql('a.', 'b.')} <= 40)
 SELECT page_idx, a_ord, b_ord, {', '.join(f'{e} AS {n}' for n, e in _PEER.items())} FROM m"""
)
def element_peers(spark: SparkSession, d: str) -> DataFrame:
    from pagefold.functions.geometry import gap
    from pagefold.operators.boxjoin import box_join

    a = stored(atoms(spark, d).select("page_idx", "ord", *BOX))
    pairs = box_join(a, a, reach=40.0, where=(F.col("a_ord") != F.col("b_ord")) & (gap("a_", "b_") <= 40))
    rules = {"meet": v.images_meet("a_", "b_"), "nested": v.is_nested_peer("a_", "b_"), "subordinate": v.is_subordinate_peer("a_", "b_"), "near": annotations.is_near("a_", "b_")}
    return pairs.select("page_idx", "a_ord", "b_ord", *[c.alias(n) for n, c in rules.items()])


_MARKS = "concat_ws('|', CASE WHEN xref % 3 = 0 OR xref % 4 = 0 THEN 'small' END, CASE WHEN xref % 5 = 0 THEN 'offpage' END)"


@query(f"{WITH_ATOMS} SELECT page_idx, ord, {_MARKS} AS reasons, {_MARKS} = '' AS active FROM atoms")
def evidence_marks(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("page_idx", "ord", F.array_join("reasons", "|").alias("reasons"), (~has_reasons("reasons")).alias("active"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("xref")
    first = F.when(x % 3 == 0, F.array(F.lit("small"), F.lit(""), F.lit(None))).otherwise(F.array().cast("array<string>"))
    more = F.array(F.when(x % 4 == 0, "small"), F.when(x % 5 == 0, "offpage"))
    return atoms(spark, d).select("page_idx", "ord", marked(first, more).alias("reasons"))


@query(
    f"""{WITH_ATOMS}, r AS (SELECT page_idx, ord, unnest(string_split({_MARKS}, '|')) AS reason, generate_subscripts(string_split({_MARKS}, '|'), 1) AS i FROM atoms), f AS (SELECT page_idx, reason, min((ord, i)) AS spot FROM r WHERE reason <> '' GROUP BY 1, 2)
 SELECT page_idx, string_agg(reason, '|' ORDER BY spot) AS reasons FROM f GROUP BY 1"""
)
def evidence_reasons(spark: SparkSession, d: str) -> DataFrame:
    return merged_reasons(_marked(spark, d), "page_idx", "ord", "reasons").select("page_idx", F.array_join("reasons", "|").alias("reasons"))


# Panels, kind by kind.

_INSIDE = "b.x0 >= a.x0 - 2 AND b.y0 >= a.y0 - 2 AND b.x1 <= a.x1 + 2 AND b.y1 <= a.y1 + 2"
_PANEL = "page_idx, '{}' AS panel_kind, source, x0, y0, x1, y1, members"
_P = {
    "border": f"SELECT a.page_idx, a.ord AS source, a.x0, a.y0, a.x1, a.y1, count(*) AS members FROM rich a JOIN rich b ON a.page_idx = b.page_idx AND {_INSIDE} WHERE a.kind = 'panel_border' GROUP BY ALL",
    "layout_column": f"""SELECT a.page_idx, a.ord AS source, a.x0, a.y0, a.x1, a.y1, count(b.ord) AS members FROM (
  SELECT page_idx, ord, least(x0, nx0, vx0) AS x0, least(y0, ny0, vy0) AS y0, greatest(x1, nx1, vx1) AS x1, greatest(y1, ny1, vy1) AS y1 FROM (
   SELECT t.*, v.x0 AS vx0, v.y0 AS vy0, v.x1 AS vx1, v.y1 AS vy1, row_number() OVER (PARTITION BY t.page_idx, t.ord ORDER BY {area_sql('v.')} DESC, v.ord) AS pick FROM (
    SELECT t.page_idx, t.ord, t.x0, t.y0, t.x1, t.y1, n.x0 AS nx0, n.y0 AS ny0, n.x1 AS nx1, n.y1 AS ny1, row_number() OVER (PARTITION BY t.page_idx, t.ord ORDER BY n.y0, n.ord) AS k FROM rich t JOIN rich n ON t.page_idx = n.page_idx AND t.ord <> n.ord AND n.y0 > t.y0 AND abs(n.x0 - t.x0) <= 6 AND abs(n.x1 - t.x1) <= 6 AND abs((n.x1 - n.x0) - (t.x1 - t.x0)) <= 6 WHERE t.kind = 'color_band' AND n.kind = 'color_band') t
   JOIN rich v ON v.page_idx = t.page_idx AND v.kind = 'vector_cluster' AND v.x0 >= t.x0 - 6 AND v.x1 <= t.x1 + 6 AND v.y0 >= t.y1 - 8 AND v.y1 <= t.ny1 + 8 WHERE t.k = 1) WHERE pick = 1) a
  LEFT JOIN rich b ON a.page_idx = b.page_idx AND {_INSIDE} AND b.kind IN ('raster_image', 'vector_cluster', 'text_block', 'color_band') GROUP BY ALL""",
}
_GOOD = "SELECT r.*, count(*) OVER (PARTITION BY page_idx) AS images FROM rich r WHERE kind = 'raster_image'"
_LARGE = _flags_sql(600, 760)["large_image"]
_P["image_seed"] = f"SELECT page_idx, ord AS source, x0, y0, x1, y1, 1 AS members FROM ({_GOOD}) WHERE (source <> 'xref' OR NOT clipped OR images = 1) AND {_LARGE}"


def _panel_sql(kind: str, body: str, ctes: str = "") -> str:
    return f"{_RICH}{ctes} SELECT {_PANEL.format(kind)} FROM ({body})"


@query(_panel_sql("border", _P["border"]))
def panels_border(spark: SparkSession, d: str) -> DataFrame:
    return panels.border_panels(rich_atoms(spark, d))


@query(_panel_sql("layout_column", _P["layout_column"]))
def panels_layout(spark: SparkSession, d: str) -> DataFrame:
    return panels.layout_panels(rich_atoms(spark, d))


@query(_panel_sql("image_seed", _P["image_seed"]))
def panels_image_seed(spark: SparkSession, d: str) -> DataFrame:
    return panels.image_seed_panels(rich_atoms(spark, d), WIDTH, HEIGHT)


_NUMBER = r"nullif(regexp_extract(text, '(?i)^\s*(?:fig(?:ure)?\.?|图|圖)\s*(\d+(?:\.\d+)*(?:-\d+)?[A-Za-z]?)(?:\s|[:：.。)、\]-]|$)', 1), '')"
_SCOPES = f"""mk AS MATERIALIZED (SELECT *, {_NUMBER} AS number FROM rich WHERE kind = 'text_block' AND {_NUMBER} IS NOT NULL),
 scope AS MATERIALIZED (SELECT page_idx, ord, number FROM (SELECT i.page_idx, i.ord, m.number, row_number() OVER (PARTITION BY i.page_idx, i.ord ORDER BY greatest(m.y0 - i.y1, 0.0), least(i.x1, m.x1) - greatest(i.x0, m.x0) DESC, m.number) AS n FROM rich i JOIN mk m USING (page_idx) WHERE i.kind = 'raster_image'
  AND (least(i.x1, m.x1) - greatest(i.x0, m.x0)) / greatest(least(i.x1 - i.x0, m.x1 - m.x0), 1.0) >= 0.2 AND m.y0 >= i.y0 - greatest(16.0, (i.y1 - i.y0) * 0.25) AND greatest(m.y0 - i.y1, 0.0) <= greatest(96.0, 760 * 0.33)) WHERE n = 1)"""
_CLUSTER_CTES = f"""good AS MATERIALIZED (SELECT g.*, s.number FROM ({_GOOD}) g LEFT JOIN scope s USING (page_idx, ord) WHERE source <> 'xref' OR NOT clipped OR images = 1),
 ilinks AS MATERIALIZED (SELECT a.page_idx, a.ord AS a, b.ord AS b FROM good a JOIN good b ON a.page_idx = b.page_idx AND a.ord <> b.ord WHERE coalesce(a.number = b.number, true) AND ((least(a.y1, b.y1) > greatest(a.y0, b.y0) AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 40) OR (least(a.x1, b.x1) > greatest(a.x0, b.x0) AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 40))),
 iwalk AS (SELECT page_idx, ord, ord AS c FROM good UNION SELECT w.page_idx, w.ord, l.b FROM iwalk w JOIN ilinks l ON l.page_idx = w.page_idx AND l.a = w.c), imember AS (SELECT page_idx, ord, min(c) AS cluster FROM iwalk GROUP BY 1, 2)"""
_P["image_cluster"] = "SELECT page_idx, cluster AS source, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS members FROM imember JOIN good USING (page_idx, ord) GROUP BY 1, 2 HAVING count(*) >= 2"
_RICH_R = _RICH.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_RICH_R}, {_SCOPES}, {_CLUSTER_CTES} SELECT {_PANEL.format('image_cluster')} FROM ({_P['image_cluster']})")
def panels_image_cluster(spark: SparkSession, d: str) -> DataFrame:
    return panels.image_cluster_panels(rich_atoms(spark, d), HEIGHT)


_BELOW = "least(a.x1, b.x1) > greatest(a.x0, b.x0) AND b.y0 - a.y1 BETWEEN 0 AND {}"
_CAPTIONED_CTES = f"""small AS MATERIALIZED (SELECT * FROM rich WHERE kind = 'raster_image' AND NOT {_LARGE}), below AS (SELECT a.page_idx, a.ord, count(*) AS captions, string_agg(DISTINCT b.number, ',' ORDER BY b.number) AS numbers FROM small a JOIN mk b ON a.page_idx = b.page_idx AND {_BELOW.format(36)} GROUP BY 1, 2)"""
_CAPTIONED = """SELECT s.page_idx, s.ord AS source, s.x0, s.y0, s.x1, s.y1, 1 AS members, coalesce(captions, CASE WHEN number IS NOT NULL THEN 1 ELSE 0 END) AS captions, coalesce(numbers, number, '') AS numbers, 0.95 AS confidence FROM small s LEFT JOIN below USING (page_idx, ord) LEFT JOIN scope USING (page_idx, ord) WHERE captions IS NOT NULL OR number IS NOT NULL"""
_P["captioned_image_seed"] = _CAPTIONED


@query(f"{_RICH}, {_SCOPES}, {_CAPTIONED_CTES} SELECT {_PANEL.format('captioned_image_seed')}, captions, numbers, confidence FROM ({_CAPTIONED})")
def panels_captioned(spark: SparkSession, d: str) -> DataFrame:
    a = rich_atoms(spark, d)
    return panels.captioned_image_panels(a, stored(panels.text_roles(a, WIDTH, HEIGHT)), WIDTH, HEIGHT)


_F = _flags_sql(600, 760)
_COMMUNITY_CTES = f"""vis AS MATERIALIZED (SELECT *, {_F['hero']} AS hero, {_F['background']} AS back FROM rich WHERE {_F['visual']}), body AS MATERIALIZED (SELECT * FROM rich WHERE {_F['body_text']}),
 vlinks AS MATERIALIZED (SELECT a.page_idx, a.ord AS a, b.ord AS b FROM vis a JOIN vis b ON a.page_idx = b.page_idx AND a.ord <> b.ord WHERE {gap_sql('a.', 'b.')} <= 60 AND NOT EXISTS (SELECT 1 FROM body t WHERE t.page_idx = a.page_idx AND ({_BARRIER.format(a='a.', b='b.').replace('>= 0.8', '>= 0.6')}))),
 vwalk AS (SELECT page_idx, ord, ord AS c FROM vis UNION SELECT w.page_idx, w.ord, l.b FROM vwalk w JOIN vlinks l ON l.page_idx = w.page_idx AND l.a = w.c), vmember AS (SELECT page_idx, ord, min(c) AS cluster FROM vwalk GROUP BY 1, 2),
 comm AS MATERIALIZED (SELECT v.page_idx, cluster AS source, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS members, bool_or(kind <> 'color_band') AS prim, bool_or(hero) AS hero, bool_or(kind = 'color_band' AND hero) AS hero_band, bool_or(kind = 'vector_cluster' AND back) AS back, count(*) FILTER (kind = 'raster_image') AS rasters,
  max({area_sql('')}) FILTER (kind = 'raster_image') AS raster_area, bool_or(kind = 'raster_image' AND v.source = 'xref' AND clipped) AS cut, (SELECT count(*) FROM rich r WHERE r.page_idx = v.page_idx AND r.kind = 'raster_image') AS images FROM vmember JOIN vis v USING (page_idx, ord) GROUP BY 1, 2),
 known AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {_PANEL.format(k)} FROM ({_P[k]})' for k in ('border', 'layout_column', 'image_seed', 'image_cluster', 'captioned_image_seed'))})"""
_P["visual_community"] = f"""SELECT page_idx, source, x0, y0, x1, y1, members FROM comm c WHERE (prim OR hero_band) AND NOT back AND (members >= 3 OR (hero AND NOT (members = 1 AND cut AND images > 1))) AND NOT coalesce(rasters = 1 AND raster_area > 0 AND {area_sql('')} / raster_area >= 4 AND raster_area / {area_sql('')} <= 0.35, false)
 AND {area_sql('')} / 456000 >= 0.03 AND NOT {_F['hangs_over']} AND NOT EXISTS (SELECT 1 FROM known k WHERE k.page_idx = c.page_idx AND {iou_sql('c.', 'k.')} > 0.9)"""
_ALL_CTES = f"{_RICH_R}, {_SCOPES}, {_CLUSTER_CTES}, {_CAPTIONED_CTES}, {_COMMUNITY_CTES}"


@query(f"{_ALL_CTES} SELECT {_PANEL.format('visual_community')} FROM ({_P['visual_community']})")
def panels_community(spark: SparkSession, d: str) -> DataFrame:
    a = rich_atoms(spark, d)
    roles = stored(panels.text_roles(a, WIDTH, HEIGHT))
    plain = ("page_idx", "panel_kind", "source", *BOX, "members")
    known = [panels.border_panels(a), panels.layout_panels(a), panels.image_seed_panels(a, WIDTH, HEIGHT), panels.image_cluster_panels(a, HEIGHT), panels.captioned_image_panels(a, roles, WIDTH, HEIGHT).select(*plain)]
    return panels.community_panels(a, stored(reduce(DataFrame.unionByName, known)), WIDTH, HEIGHT)


def _scoped_sql(of: str) -> str:
    """Caption scopes of the panels of a table, below up to 48 points or inside."""
    inside = "b.y0 >= a.y0 - 2 AND b.y1 <= a.y1 + 2 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(b.x1 - b.x0, 1.0) >= 0.5"
    return f"SELECT page_idx, panel_kind, source, count(*) AS captions, string_agg(DISTINCT number, ',' ORDER BY number) AS numbers, count(DISTINCT number) > 1 AS multi, CASE WHEN count(*) = 1 THEN 0.95 END AS confidence FROM (SELECT DISTINCT a.page_idx, a.panel_kind, a.source, b.ord, b.number FROM {of} a JOIN mk b ON a.page_idx = b.page_idx WHERE ({_BELOW.format(48)}) OR ({inside})) GROUP BY 1, 2, 3"


def _same(a: str, b: str) -> str:
    cover = f"{inter_sql(a, b)} / least({area_sql(a)}, {area_sql(b)})"
    return f"({iou_sql(a, b)} > 0.9 OR ({cover} > 0.8 AND {area_sql(b)} / greatest({area_sql(a)}, 1.0) >= 0.8))"


def _anchor_sql(rounds: int = 3) -> str:
    """Anchors, then those that an earlier one makes redundant, round by round."""
    parts = [
        f"known2 AS MATERIALIZED (SELECT * FROM known UNION ALL SELECT {_PANEL.format('visual_community')} FROM ({_P['visual_community']}))",
        f"spread AS ({_scoped_sql('known2')})",
        f"""anchors AS MATERIALIZED (SELECT page_idx, ord, min(vx0) AS x0, min(vy0) AS y0, max(vx1) AS x1, max(vy1) AS y1, count(*) AS members FROM (SELECT c.page_idx, c.ord, v.x0 AS vx0, v.y0 AS vy0, v.x1 AS vx1, v.y1 AS vy1 FROM mk c JOIN rich v USING (page_idx) WHERE v.kind IN ('raster_image', 'vector_cluster', 'color_band', 'panel_border')
 AND NOT {_F['spans_page'].replace('x0', 'v.x0').replace('x1', 'v.x1').replace('y0', 'v.y0').replace('y1', 'v.y1')} AND c.y0 - v.y1 BETWEEN 0 AND 760 * 0.08::DOUBLE AND c.y0 - v.y0 <= 760 * 0.45::DOUBLE AND (least(c.x1, v.x1) - greatest(c.x0, v.x0)) / greatest(1.0, least(c.x1 - c.x0, v.x1 - v.x0)) >= 0.2) GROUP BY 1, 2 HAVING (max(vx1) - min(vx0)) * (max(vy1) - min(vy0)) / 456000 >= 0.005)""",
        f"fresh AS MATERIALIZED (SELECT * FROM anchors a WHERE NOT EXISTS (SELECT 1 FROM known2 k LEFT JOIN spread s USING (page_idx, panel_kind, source) WHERE k.page_idx = a.page_idx AND NOT coalesce(s.multi, false) AND {_same('a.', 'k.')}))",
        f"rv0 AS MATERIALIZED (SELECT a.page_idx, b.ord AS better, a.ord AS worse FROM fresh a JOIN fresh b ON a.page_idx = b.page_idx AND b.ord < a.ord AND {_same('a.', 'b.')})",
    ]
    for i in range(rounds):
        parts.append(f"out{i} AS MATERIALIZED (SELECT DISTINCT page_idx, worse AS ord FROM rv{i} r WHERE NOT EXISTS (SELECT 1 FROM rv{i} x WHERE x.page_idx = r.page_idx AND x.worse = r.better))")
        parts.append(f"rv{i + 1} AS MATERIALIZED (SELECT * FROM rv{i} r WHERE NOT EXISTS (SELECT 1 FROM out{i} o WHERE o.page_idx = r.page_idx AND o.ord IN (r.better, r.worse)))")
    gone = " UNION ALL ".join(f"SELECT * FROM out{i}" for i in range(rounds))
    return ", ".join([*parts, f"anchored AS MATERIALIZED (SELECT page_idx, 'caption_anchor_visual' AS panel_kind, ord AS source, x0, y0, x1, y1, members FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM ({gone}) g WHERE g.page_idx = f.page_idx AND g.ord = f.ord))"])


_KINDS = "[" + ", ".join(repr(k) for k in panels.PANEL_KINDS) + "]"


@query(
    f"""{_ALL_CTES}, {_anchor_sql()}, allp AS MATERIALIZED (SELECT * FROM known2 UNION ALL SELECT * FROM anchored), sc AS ({_scoped_sql('allp')})
 SELECT page_idx, (list_position({_KINDS}, panel_kind) - 1) * 4294967296 + source AS id, panel_kind, source, x0, y0, x1, y1, members, coalesce(captions, 0) AS captions, coalesce(numbers, '') AS numbers, coalesce(multi, false) AS multi, confidence FROM allp LEFT JOIN sc USING (page_idx, panel_kind, source)"""
)
def panel_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Panels of all kinds, those above captions too, with their caption scopes."""
    return panels.propose_panels(rich_atoms(spark, d), WIDTH, HEIGHT)


_BASE_SQL = "CASE panel_kind WHEN 'layout_column' THEN 0.2 WHEN 'image_cluster' THEN 0.1 WHEN 'captioned_image_seed' THEN 0.05 WHEN 'caption_anchor_visual' THEN 0.25 ELSE 0.0 END"
_SEEDS_SQL = f"SELECT *, round({_BASE_SQL} + CAST(members AS DECIMAL(9,1)) * 0.1, 4) AS score FROM ({SQL['panel_proposals']})"


@query(
    f"""WITH RECURSIVE {_RICH[5:]}, s AS MATERIALIZED ({_SEEDS_SQL}), lone AS (SELECT s.page_idx, s.id, r.kind FROM s JOIN rich r ON r.page_idx = s.page_idx AND r.ord = s.source)
 SELECT s.page_idx, s.id, panel_kind, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY s.page_idx ORDER BY score DESC, s.id) AS place, CASE WHEN panel_kind = 'image_cluster' THEN CASE WHEN members > 1 THEN 'L2' ELSE 'L1' END WHEN panel_kind IN ('visual_community', 'layout_column', 'caption_anchor_visual') THEN 'L2' ELSE 'L1' END AS level,
 (y0 <= 760 * 0.12::DOUBLE OR y1 >= 760 * 0.88::DOUBLE) AND ({area_sql('')} / 456000 <= 0.01 OR ((x1 - x0) / 600 <= 0.2 AND (y1 - y0) / 760 <= 0.08)) AND members <= 1 AND panel_kind IN ('captioned_image_seed', 'image_seed') AND lone.kind = 'raster_image' AS boilerplate FROM s JOIN lone USING (page_idx, id)"""
)
def panel_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of the panels in order of their scores, with their level and whether they are boilerplate."""
    from pagefold.plans.partitioning import ordered_positions

    a = rich_atoms(spark, d)
    p = panels.propose_panels(a, WIDTH, HEIGHT).join(a.select("page_idx", F.col("ord").alias("source"), "kind"), ["page_idx", "source"])
    seeds = p.withColumn("score", ranking.seed_score(F.col("panel_kind"), F.col("members")))
    tags = F.array("panel_kind")
    low = v.is_boilerplate_seed(F.array("kind"), F.col("members"), tags, "", WIDTH, HEIGHT)
    placed = ordered_positions(seeds, "page_idx", [F.col("score").desc(), F.col("id").asc()])
    return placed.select("page_idx", "id", "panel_kind", "score", (F.col("group_pos") + 1).alias("place"), ranking.level(F.col("panel_kind"), tags, F.col("members")).alias("level"), low.alias("boilerplate"))



