"""Reading the parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions.spelling import confidence, label, paper


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that a fixed table (settings, targets) may have to be held on the driver.
MAX_FIXED = 10_000


def fixed_rows(df: DataFrame, name: str, most: int = MAX_FIXED) -> list:
    """All rows of a fixed table; one of more than ``most`` rows is refused, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name} has more than {most} rows")
    return rows


def settings(spark: SparkSession, folder: str) -> dict[str, float]:
    """The fixed table ``job_settings`` as a dict."""
    return {r["setting_name"]: r["setting_num"] for r in fixed_rows(table(spark, folder, "job_settings"), "job_settings")}


def current_rows(pages: DataFrame, *columns: str) -> DataFrame:
    """The row of each ``page_id`` with the highest ``row_no``; rows without ``page_id`` are no page.

    A ``max_by`` combined before the shuffle: history never travels, however often one page was indexed.
    """
    kept = [c for c in columns if c != "page_id"]
    newest = pages.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max_by(F.struct(*kept), F.coalesce("row_no", F.lit(-1))).alias("r"))
    return newest.select("page_id", *[F.col(f"r.{c}").alias(c) for c in kept])


def current_pages(pages: DataFrame) -> DataFrame:
    """Current rows with the keys of their spellings: ``page_id, doc_id, paper, family, level, score``."""
    now = current_rows(pages, "doc_id", "figure_family", "difficulty", "classification_confidence")
    return now.select("page_id", "doc_id", paper("doc_id").alias("paper"), label("figure_family").alias("family"), label("difficulty").alias("level"), confidence("classification_confidence").alias("score"))
