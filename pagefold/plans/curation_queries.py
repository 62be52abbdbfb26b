"""Queries of problems 2 and 3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions.spelling import paper, paper_sql, place, place_sql
from pagefold.functions.values import computed
from pagefold.operators.drift import conformed, declared_of, departures, file_headers, promoted, readable, unified, union_fields, unreadable
from pagefold.operators.orphans import is_orphan, orphan_report, parent_intervals, resolve_references
from pagefold.sources.tables import table

FILES = (("gt", "gt_files", "figures"), ("meta", "meta_files", None))


def _departures(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    declared = table(spark, d, "declared_fields")
    parts = []
    for kind, name, inner in FILES:
        files = table(spark, d, name).select(F.struct("file_path", *extra).alias("file"), "body")
        parts.append(departures(file_headers(files, "file", "body", inner), declared_of(declared, kind), "file"))
    return reduce(DataFrame.unionByName, parts).select("file.*", "holder", "at", "field_name", "change_type", "found")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _departures(spark, d).select("file_path", "field_name", "change_type").distinct()


def p2_log(spark: SparkSession, d: str) -> DataFrame:
    """The log: each departure with the number of its objects and of the files that show it, in order of the time they were written."""
    log = _departures(spark, d, "batch", "written_at")
    change = ("holder", "field_name", "change_type", "found")
    per_file = log.groupBy(*change, "file_path").agg(F.count(F.lit(1)).alias("n"), F.min("written_at").alias("first_at"), F.max("written_at").alias("last_at"), F.min(F.struct("written_at", "file_path", "batch")).alias("first"))
    grouped = per_file.groupBy(*change).agg(F.sum("n").alias("objects"), F.count("file_path").alias("files"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("first")["batch"].alias("first_batch"))
    return grouped.orderBy("first_at", "holder", "field_name", "change_type", "found")


def p2_schema(spark: SparkSession, d: str) -> DataFrame:
    """The union schema of both kinds of file, each field's kinds promoted."""
    parts = [promoted(file_headers(table(spark, d, name), "file_path", "body", inner)).withColumn("file_kind", F.lit(kind)) for kind, name, inner in FILES]
    return reduce(DataFrame.unionByName, parts)


def _table(kind: str, holder: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        _, name, inner = next(f for f in FILES if f[0] == kind)
        return conformed(table(spark, d, name), "file_path", "body", declared_of(table(spark, d, "declared_fields"), kind), holder, inner)

    return query


def _unified(kind: str, holder: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """All files of a kind cast to the union schema that their headers fold to."""
        _, name, inner = next(f for f in FILES if f[0] == kind)
        files = table(spark, d, name)
        fields = union_fields(promoted(file_headers(files, "file_path", "body", inner if holder == "figure" else None)), holder)
        return unified(files, "file_path", "body", fields, holder, inner)

    return query


def p2_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Files without a readable body, each copy, with the reason: they are in no table."""
    parts = [unreadable(table(spark, d, name), "file_path", "body").withColumn("file_kind", F.lit(kind)) for kind, name, _ in FILES]
    return reduce(DataFrame.unionByName, parts)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    pages, pool = table(spark, d, "page_index"), table(spark, d, "source_pool")
    artifacts, meta = table(spark, d, "artifact_files"), table(spark, d, "meta_files")
    ref = lambda t, f: (F.lit(t).alias("ref_table"), F.lit(f).alias("ref_field"))
    both = F.explode(F.array(F.struct(F.lit("overlay_path").alias("f"), place("overlay_path").alias("p")), F.struct(F.lit("page_dir").alias("f"), place("page_dir").alias("p")))).alias("x")
    paths = pages.select(F.col("row_no").cast("string").alias("ref_key"), F.col("indexed_at").alias("at"), both).select(F.lit("page_index").alias("ref_table"), F.col("x.f").alias("ref_field"), "ref_key", "at", F.col("x.p").alias("target"))
    pdfs = pool.select(*ref("source_pool", "local_pdf_path"), F.col("doc_id").alias("ref_key"), F.col("added_at").alias("at"), place("local_pdf_path").alias("target"))
    spread = F.concat_ws("\x1f", "ref_key", "at")
    files = resolve_references(paths.unionByName(pdfs).withColumn("spread", spread), parent_intervals(artifacts.select(place("file_path").alias("key"), "written_at", "deleted_at"), "key", "written_at", "deleted_at"), "target", "at", "spread")
    doc = computed(meta, _doc=F.try_variant_get(readable(F.col("body")), "$.doc_id", "string"))
    named = doc.select(*ref("meta_files", "doc_id"), F.col("file_path").alias("ref_key"), F.col("written_at").alias("at"), paper("_doc").alias("target"))
    papers = resolve_references(named.withColumn("spread", spread), parent_intervals(pool.select(paper("doc_id").alias("key"), "added_at", "removed_at"), "key", "added_at", "removed_at"), "target", "at", "spread")
    return files.unionByName(papers).drop("spread")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).where(is_orphan()).select("ref_table", "ref_field", "ref_key").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_resolved(spark, d), "at")


def _p3_sql() -> str:
    meta = "CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN json_extract_string(body, '$.doc_id') END"
    live = {"f": f"SELECT DISTINCT {place_sql('file_path')} AS k FROM artifact_files WHERE deleted_at IS NULL", "p": f"SELECT DISTINCT {paper_sql('doc_id')} AS k FROM source_pool WHERE removed_at IS NULL"}
    one = lambda t, f, key, target, of: f"SELECT DISTINCT '{t}' AS ref_table, '{f}' AS ref_field, {key} AS ref_key FROM (SELECT *, {target} AS k FROM {t}) r WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM live_{of} l WHERE l.k = r.k)"
    return f"WITH live_f AS ({live['f']}), live_p AS ({live['p']}) " + " UNION ALL ".join(
        [
            one("page_index", "overlay_path", "CAST(row_no AS VARCHAR)", place_sql("overlay_path"), "f"),
            one("page_index", "page_dir", "CAST(row_no AS VARCHAR)", place_sql("page_dir"), "f"),
            one("source_pool", "local_pdf_path", "doc_id", place_sql("local_pdf_path"), "f"),
            one("meta_files", "doc_id", "file_path", paper_sql(f"({meta})"), "p"),
        ]
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_log": p2_log,
    "p2_schema": p2_schema,
    "p2_unreadable": p2_unreadable,
    "p2_gt_pages_union": _unified("gt", "page"),
    "p2_gt_figures_union": _unified("gt", "figure"),
    "p2_meta_union": _unified("meta", "page"),
    "p2_gt_pages": _table("gt", "page"),
    "p2_gt_figures": _table("gt", "figure"),
    "p2_meta_pages": _table("meta", "page"),
    "p3_found": p3_found,
    "p3_report": p3_report,
}
def _unreadable_sql(kind: str, name: str) -> str:
    reason = r"CASE WHEN body IS NULL THEN 'null' WHEN trim(body, E' \t\r\n') = '' THEN 'blank' WHEN NOT json_valid(body) OR json_type(body) <> 'OBJECT' THEN 'not one JSON object' END"
    return f"SELECT file_path, '{kind}' AS file_kind, reason FROM (SELECT file_path, {reason} AS reason FROM {name}) WHERE reason IS NOT NULL"


SQL = {"p3_found": _p3_sql(), "p2_unreadable": " UNION ALL ".join(_unreadable_sql(kind, name) for kind, name, _ in FILES)}
