"""Reading and writing the files of a run: label pages, predictions, indexes, content lists, stage tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "array<double>"
LABEL_PAGE = f"page_idx int, page_label string, figures array<struct<figure_id: string, bbox: {BOX}, logical_group_id: string, panel_bboxes: array<{BOX}>, caption_bbox: {BOX}, body_exclusion_bboxes: array<{BOX}>>>"
FIGURE = f"figure_id string, bbox {BOX}, page_idx int"
PAGE_INDEX = ", ".join(f"{c} string" for c in ("page_id", "candidate_id", "doc_id", "page_idx", "page_label", "figure_family", "difficulty", "classification_confidence", "overlay_path", "page_dir", "shortlist_reason"))
SOURCE_POOL = ", ".join(f"{c} string" for c in ("doc_id", "title", "language", "source_pdf_name", "local_pdf_path", "license_or_use_note", "allow_in_dataset", "notes"))


def _stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)


def corners(box: str) -> list:
    """A box array as four columns; null where it hasn't four numbers."""
    ok = F.size(box) == 4
    return [F.when(ok, F.get(box, F.lit(i))).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]


def read_label_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per label file, ``page_id`` from its name; a file that isn't one JSON object of the schema has nulls."""
    return spark.read.schema(LABEL_PAGE).option("multiLine", True).json(f"{folder}/*.json").withColumn("page_id", _stem())


def label_figures(pages: DataFrame) -> DataFrame:
    """Figures of label pages in their order."""
    out = pages.select("page_id", "page_idx", F.posexplode("figures").alias("ord", "f"))
    return out.select("page_id", "page_idx", "ord", "f.figure_id", F.col("f.logical_group_id").alias("group_id"), *corners("f.bbox"), F.coalesce(F.size("f.panel_bboxes"), F.lit(0)).alias("panels"), F.col("f.caption_bbox").isNotNull().alias("has_caption"))


def read_predictions(spark: SparkSession, run: str) -> DataFrame:
    """Figures of ``pages/page_*/figures.json`` of a run; the page index falls back to the directory's number."""
    raw = spark.read.text(f"{run}/pages/page_*/figures.json", wholetext=True).withColumn("path", F.input_file_name())
    items = raw.select("path", F.posexplode(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in FIGURE.split(', '))}>>")).alias("ord", "f"))
    from_name = F.regexp_extract("path", r"page_(\d+)/figures\.json$", 1).cast("int")
    return items.select(F.coalesce("f.page_idx", from_name).alias("page_idx"), "ord", "f.figure_id", *corners("f.bbox"))


def read_index(spark: SparkSession, path: str, schema: str = PAGE_INDEX) -> DataFrame:
    """A CSV with header and quoted commas; all columns are text."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_content_list(spark: SparkSession, path: str) -> DataFrame:
    """Items of content lists, each file a JSON list or an object with ``content_list``: ``path, ord, type, text, page_idx, bbox``; else no rows."""
    body = F.try_parse_json("value")
    items = F.coalesce(F.try_variant_get(body, "$.content_list", "array<variant>"), F.try_variant_get(body, "$", "array<variant>"))
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(items).alias("ord", "i"))
    field = lambda name, kind: F.try_variant_get("i", f"$.{name}", kind).alias(name)
    return raw.select("path", "ord", F.lower(field("type", "string")).alias("type"), field("text", "string"), field("page_idx", "int"), field("bbox", BOX))


def write_stage(df: DataFrame, path: str, *partitions: str) -> None:
    """A stage table as parquet; an existing one is never replaced."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def page_contract(figures: DataFrame) -> DataFrame:
    """Figures of each page as one public JSON record, in order; the group falls back to the figure, the content box to the box."""
    f = figures
    group = F.coalesce("group_id", "figure_id") if "group_id" in f.columns else F.col("figure_id")
    item = F.struct("ord", F.col("figure_id"), group.alias("logical_group_id"), F.array("x0", "y0", "x1", "y1").alias("figure_bbox"))
    ordered = F.transform(F.sort_array(F.collect_list(item)), lambda i: i.dropFields("ord"))
    return f.groupBy("page_idx").agg(F.to_json(F.struct(F.first("page_idx").alias("page_idx"), ordered.alias("images"))).alias("record"))


def group_report(rows: DataFrame, title: str, key: str) -> DataFrame:
    """A Markdown table of micro metrics by ``key`` as one text row."""
    line = F.format_string("| %s | %d | %.4f | %.4f | %.4f |", F.col(key), F.col("page_count"), F.col("precision"), F.col("recall"), F.col("f1"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("f1")).alias("o"), F.col(key).alias("k"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.where(F.col(key).isNotNull()).agg(F.concat(F.lit(f"## {title}\n\n| {key} | pages | precision | recall | F1 |\n| --- | --- | --- | --- | --- |\n"), body).alias("value"))
