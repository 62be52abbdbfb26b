"""Layouts derived from the supplied order tables: pages are orders, atoms their lines. They exercise operators, not extraction quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefold.plans.shared import stored
from pagefold.sources.tables import table

WIDTH, HEIGHT = 600.0, 760.0
KINDS = ("text_block", "raster_image", "vector_cluster", "panel_border", "color_band")


def atoms(spark: SparkSession, d: str) -> DataFrame:
    """``page_idx, ord, kind, x0, y0, x1, y1, text, xref``: one atom per order line, in a fixed order per page."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x0, y0 = p * 37 % 400, s * 53 % 600
    words = F.when(p % 3 == 0, F.concat(F.lit("Figure "), (p % 9 + 1).cast("string"), F.lit(": part "), p.cast("string"))).when(p % 3 == 1, F.concat(F.lit("see Fig. "), (p % 7 + 1).cast("string"), F.lit(" for details of supplier "), s.cast("string"))).otherwise(F.concat(F.lit("body text of part "), p.cast("string")))
    return lines.select(
        F.col("l_orderkey").alias("page_idx"),
        F.row_number().over(by).alias("ord"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (p % 5 + 1).cast("int")).alias("kind"),
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        (x0 + 40 + p % 160).cast("double").alias("x1"),
        (y0 + 30 + s % 120).cast("double").alias("y1"),
        F.when(p % 5 == 0, words).alias("text"),
        (p % 97).alias("xref"),
    )


def stored_atoms(spark: SparkSession, d: str) -> DataFrame:
    """The atoms, derived once and stored: for queries that read them several times."""
    return stored(atoms(spark, d), "atoms")


def predictions(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """A second system: the atoms (``of``) moved a little, every seventh dropped."""
    dx, dy = F.col("ord") * 7 % 30, F.col("ord") * 11 % 24
    return (atoms(spark, d) if of is None else of).where(F.col("ord") % 7 != 0).select("page_idx", "ord", "kind", *[(F.col(c) + (dx if c[0] == "x" else dy)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def pages(spark: SparkSession, d: str) -> DataFrame:
    """The spine: every page, those without atoms too, with two labels and the document it belongs to."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("page_idx"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("difficulty"))


ATOMS_SQL = """SELECT l_orderkey AS page_idx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS ord,
 ['text_block', 'raster_image', 'vector_cluster', 'panel_border', 'color_band'][l_partkey % 5 + 1] AS kind,
 CAST(l_partkey * 37 % 400 AS DOUBLE) AS x0, CAST(l_suppkey * 53 % 600 AS DOUBLE) AS y0,
 CAST(l_partkey * 37 % 400 + 40 + l_partkey % 160 AS DOUBLE) AS x1, CAST(l_suppkey * 53 % 600 + 30 + l_suppkey % 120 AS DOUBLE) AS y1,
 CASE WHEN l_partkey % 5 = 0 THEN CASE l_partkey % 3 WHEN 0 THEN 'Figure ' || (l_partkey % 9 + 1) || ': part ' || l_partkey WHEN 1 THEN 'see Fig. ' || (l_partkey % 7 + 1) || ' for details of supplier ' || l_suppkey ELSE 'body text of part ' || l_partkey END END AS text,
 l_partkey % 97 AS xref FROM lineitem"""
PREDICTIONS_SQL = f"SELECT page_idx, ord, kind, x0 + ord * 7 % 30 AS x0, y0 + ord * 11 % 24 AS y0, x1 + ord * 7 % 30 AS x1, y1 + ord * 11 % 24 AS y1 FROM ({ATOMS_SQL}) WHERE ord % 7 <> 0"
PAGES_SQL = "SELECT o_orderkey AS page_idx, o_custkey AS doc_id, o_orderpriority AS family, o_orderstatus AS difficulty FROM orders"
