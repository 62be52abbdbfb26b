"""Queries over texts and the dataset's own tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions import text as t
from pagefold.functions.spelling import confidence_sql, label_sql, paper, paper_sql
from pagefold.operators.reports import missing_parts, overview, recount
from pagefold.plans.layout_queries import WITH_ATOMS
from pagefold.sources.layouts import atoms, pages
from pagefold.sources.tables import current_pages, current_rows, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CURRENT = f"""(SELECT page_id, doc_id, {paper_sql('doc_id')} AS paper, {label_sql('figure_family')} AS family, {label_sql('difficulty')} AS level, {confidence_sql('classification_confidence')} AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY row_no DESC) AS nth FROM page_index WHERE page_id IS NOT NULL) WHERE nth = 1)"""
# RE2 has no lookahead: the end of a label is a consuming group there.
_PRE, _NUM, _END = r"(?:fig(?:ure)?\.?|图|圖)", r"\d+(?:\.\d+)*(?:-\d+)?[A-Za-z]?", r"(?:[ \t\n\r\f]|[:：.。)、\]-]|$)"
_CAP, _REF = rf"(?i)^\s*({_PRE})\s*({_NUM}){_END}", rf"(?i)({_PRE})\s*({_NUM}){_END}"
_LINES = "(SELECT doc_id, unnest(string_split(text, E'\\n')) AS line FROM documents WHERE text IS NOT NULL)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(
    rf"""SELECT doc_id, role, number, count(*) AS lines FROM (SELECT doc_id,
 CASE WHEN regexp_matches(b, '{_CAP}') AND length(b) <= 520 THEN 'figure_caption' WHEN regexp_matches(b, '{_CAP}') THEN 'body_reference' WHEN regexp_matches(b, '^(\([a-zA-Z]\)|[a-zA-Z]\))$') THEN 'subfigure_label' WHEN regexp_matches(b, '{_REF}') THEN 'body_reference' END AS role,
 CASE WHEN regexp_matches(b, '{_CAP}') THEN regexp_extract(b, '{_CAP}', 2) WHEN regexp_matches(b, '^(\([a-zA-Z]\)|[a-zA-Z]\))$') THEN NULL WHEN regexp_matches(b, '{_REF}') THEN regexp_extract(b, '{_REF}', 2) END AS number
 FROM (SELECT doc_id, trim(line) AS b FROM {_LINES})) WHERE role IS NOT NULL GROUP BY 1, 2, 3"""
)
def text_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of text lines and the figure numbers they name."""
    role = _lines(spark, d).select("doc_id", t.text_role(F.col("line")).alias("r")).where("r IS NOT NULL")
    return role.groupBy("doc_id", F.col("r.role").alias("role"), F.col("r.number").alias("number")).agg(F.count(F.lit(1)).alias("lines"))


_TOKENS = r"regexp_extract_all(text, '[A-Za-z]+|[0-9]+(?:\.[0-9]+)?')"


@query(
    rf"""SELECT doc_id, len(regexp_extract_all(text, '[㐀-鿿]')) AS cjk, len(regexp_extract_all(text, '[-+]?[0-9]+(?:\.[0-9]+)?')) AS numbers,
 round(CASE WHEN len({_TOKENS}) > 0 THEN CAST(len(list_filter({_TOKENS}, lambda x: x SIMILAR TO '[0-9].*')) AS DOUBLE) / len({_TOKENS}) END, 4) AS numeric_share,
 len({_TOKENS}) >= 6 AND coalesce(CAST(len(list_filter({_TOKENS}, lambda x: x SIMILAR TO '[0-9].*')) AS DOUBLE) / len({_TOKENS}), 0) >= 0.3 AS table_like,
 contains(lower(text), 'workflow') OR contains(lower(text), 'pipeline') OR contains(lower(text), 'layout') AS keyword,
 regexp_replace(paper_id, '[^a-zA-Z0-9._-]+', '_', 'g') AS run_name FROM documents WHERE text <> ''"""
)
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").where("text <> ''").select(
        "doc_id", t.cjk_chars(c).alias("cjk"), F.regexp_count(c, F.lit(r"[-+]?[0-9]+(?:\.[0-9]+)?")).alias("numbers"), F.round(t.numeric_share(c), 4).alias("numeric_share"), t.looks_like_table_row(c).alias("table_like"), t.has_keyword(c, ("workflow", "pipeline", "layout")).alias("keyword"), t.safe_run_name(F.col("paper_id")).alias("run_name")
    )


@query(f"SELECT * FROM {CURRENT}")
def current_page_labels(spark: SparkSession, d: str) -> DataFrame:
    return current_pages(table(spark, d, "page_index"))


@query(f"SELECT count(*) AS pages, count(*) FILTER (family IS DISTINCT FROM 'hard_negative') AS positive, count(*) FILTER (family = 'hard_negative') AS negative, count(DISTINCT paper) AS papers, count(DISTINCT coalesce(family, 'unknown') || '|' || coalesce(level, 'unknown')) AS buckets FROM {CURRENT}")
def dataset_recount(spark: SparkSession, d: str) -> DataFrame:
    return recount(current_pages(table(spark, d, "page_index")))


@query(f"SELECT coalesce(family, 'unknown') AS family, coalesce(level, 'unknown') AS level, count(*) AS pages, count(score) AS scored, sum(CAST(score AS DECIMAL(18,8))) AS total_score FROM {CURRENT} GROUP BY GROUPING SETS ((1, 2), ())")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    named = current_pages(table(spark, d, "page_index")).withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("family", "level")})
    return named.groupingSets([["family", "level"], []], "family", "level").agg(F.count(F.lit(1)).alias("pages"), F.count("score").alias("scored"), F.sum(F.col("score").cast("decimal(18,8)")).alias("total_score"))


_STEM = "regexp_extract(file_path, '([^/]+)\\.json$', 1)"


@query(
    f"""WITH now AS {CURRENT}, gt AS (SELECT DISTINCT {_STEM} AS page_id FROM gt_files), meta AS (SELECT DISTINCT {_STEM} AS page_id FROM meta_files)
 SELECT page_id, 'missing_gt' AS reason FROM now WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.page_id = now.page_id) UNION ALL SELECT page_id, 'missing_meta' FROM now WHERE NOT EXISTS (SELECT 1 FROM meta WHERE meta.page_id = now.page_id)"""
)
def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    """Current pages without a label or meta file."""
    stem = F.regexp_extract("file_path", r"([^/]+)\.json$", 1).alias("page_id")
    now = current_rows(table(spark, d, "page_index"), "doc_id")
    return missing_parts(now, {name: table(spark, d, f"{name}_files").select(stem) for name in ("gt", "meta")}, "page_id")


@query(
    f"""WITH now AS {CURRENT}, pool AS (SELECT * FROM (SELECT {paper_sql('doc_id')} AS paper, local_pdf_path, title, row_number() OVER (PARTITION BY {paper_sql('doc_id')} ORDER BY added_at DESC NULLS LAST, local_pdf_path DESC NULLS LAST, title DESC NULLS LAST) AS n FROM source_pool WHERE removed_at IS NULL) WHERE n = 1 AND paper IS NOT NULL)
 SELECT now.page_id, now.paper, pool.local_pdf_path, pool.title FROM now LEFT JOIN pool ON now.paper = pool.paper"""
)
def page_sources(spark: SparkSession, d: str) -> DataFrame:
    """Current pages with the latest pool entry of their paper, whatever its spelling."""
    from pagefold.plans.partitioning import merge_lookup

    low = lambda c: F.coalesce(c, F.lit(""))
    pool = table(spark, d, "source_pool").where("removed_at IS NULL").select(paper("doc_id").alias("paper"), "local_pdf_path", "title", "added_at").where("paper IS NOT NULL")
    latest = pool.groupBy("paper").agg(F.max_by(F.struct("local_pdf_path", "title"), F.struct("added_at", F.col("local_pdf_path").isNotNull(), low("local_pdf_path"), F.col("title").isNotNull(), low("title"))).alias("p"))
    now = current_pages(table(spark, d, "page_index"))
    return merge_lookup(now, latest, "paper", F.col("page_id")).select("page_id", "paper", "p.local_pdf_path", "p.title")


@query(
    f"""{WITH_ATOMS}, s AS (SELECT p.doc_id, p.page_idx, count(a.ord) FILTER (a.kind = 'raster_image') AS figures, coalesce(max(a.xref) FILTER (a.kind = 'raster_image'), 0) % 10 / 10.0 AS contamination, coalesce(max(a.xref), 0) % 7 / 7.0 AS overmerge FROM pages p LEFT JOIN atoms a USING (page_idx) GROUP BY 1, 2)
 SELECT doc_id, count(*) AS pages, CAST(sum(figures) AS BIGINT) AS figures, round(coalesce(avg(contamination) FILTER (figures > 0), 0.0), 4) AS mean_contamination, max(overmerge) AS max_overmerge FROM s GROUP BY 1"""
)
def document_overview(spark: SparkSession, d: str) -> DataFrame:
    a = atoms(spark, d)
    top = lambda cond, m: F.coalesce(F.max(F.when(cond, F.col("xref"))), F.lit(0)) % m / float(m)
    raster = F.col("kind") == "raster_image"
    per = pages(spark, d).select("doc_id", "page_idx").join(a, "page_idx", "left").groupBy("doc_id", "page_idx").agg(F.count_if(raster).alias("figures"), top(raster, 10).alias("contamination"), top(F.lit(True), 7).alias("overmerge"))
    return overview(per, "doc_id")
