"""Queries of problems 1 and 4 to 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.functions.spelling import confidence_sql, label, label_sql, paper, paper_sql
from pagefold.llm.cap import cap_contributors
from pagefold.llm.encode import count_tokens, encode_column
from pagefold.llm.mix import mix_documents, mix_report, plan_mix, token_sizes
from pagefold.llm.repeat import repetition
from pagefold.llm.sample import margin_report, plan_sample, sample_to_targets
from pagefold.llm.split import ComponentStore, related_classes, related_pairs
from pagefold.plans.partitioning import adaptive_lookup, key_loads, merge_lookup
from pagefold.plans.shared import new_table_path, stored
from pagefold.sources.tables import current_pages, fixed_rows, settings, table

CURRENT_SQL = f"""(SELECT page_id, {paper_sql('doc_id')} AS paper, {label_sql('figure_family')} AS family, {label_sql('difficulty')} AS level, {confidence_sql('classification_confidence')} AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY row_no DESC) AS nth FROM page_index WHERE page_id IS NOT NULL) WHERE nth = 1)"""


def p1_pages(spark: SparkSession, d: str) -> DataFrame:
    """Current pages that name a paper, with their place in it and whether they are kept."""
    pages = current_pages(table(spark, d, "page_index")).select("page_id", "paper", "score")
    return cap_contributors(pages, "paper", [F.col("score").desc_nulls_last(), F.col("page_id").asc()], cap=int(settings(spark, d)["cap_pages"]))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pages(spark, d).where(~F.col("kept")).select("page_id")


_RANKED_SQL = f"""SELECT page_id, row_number() OVER (PARTITION BY paper ORDER BY score DESC NULLS LAST, page_id) AS position FROM {CURRENT_SQL} WHERE paper IS NOT NULL"""
_CAP_SQL = "(SELECT setting_num FROM job_settings WHERE setting_name = 'cap_pages')"


_LABELS, _TARGET_LABELS = ("family", "level"), ("_family", "_level")


def _sample_plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = current_pages(table(spark, d, "page_index")).select("page_id", "family", "level")
    targets = table(spark, d, "sample_targets").withColumns({"_family": label("figure_family"), "_level": label("difficulty")})
    return pages, plan_sample(pages, targets, _LABELS, _TARGET_LABELS, settings(spark, d)["sample_share"])


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    pages, report = _sample_plan(spark, d)
    return sample_to_targets(pages, report, "page_id", _LABELS, _TARGET_LABELS)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Targets with what they need, have, lack, want in the sample and get."""
    return _sample_plan(spark, d)[1].drop(*_TARGET_LABELS)


def p4_needs(spark: SparkSession, d: str) -> DataFrame:
    """The part of the report that no draw decides."""
    return p4_report(spark, d).select("figure_family", "difficulty", "need", "available", "own", "slack")


def p4_margins(spark: SparkSession, d: str) -> DataFrame:
    """Both margins of the sample: what the cells of each label want, get and lack."""
    return margin_report(p4_report(spark, d), "figure_family", "difficulty")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets whose need flows over a slack arc."""
    return p4_report(spark, d).where("slack > 0").select("figure_family", "difficulty").distinct()


_NEEDS_SQL = f"""WITH now AS {CURRENT_SQL}, n AS (SELECT count(*) AS n FROM now WHERE family IS NOT NULL AND level IS NOT NULL),
 needs AS (SELECT t.figure_family, t.difficulty, (SELECT count(*) FROM now WHERE family = {label_sql('t.figure_family')} AND level = {label_sql('t.difficulty')}) AS available,
  CAST(greatest(t.min_pages, ceil(CAST(t.target_share AS DECIMAL(18,6)) * CAST((SELECT setting_num FROM job_settings WHERE setting_name = 'sample_share') AS DECIMAL(9,6)) * n.n)) AS BIGINT) AS need FROM sample_targets t, n)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``page_index`` with the entity they belong to: the paper, or the page or row itself where none is named."""
    page = F.when(F.btrim("page_id") != "", F.col("page_id"))
    alone = F.concat(F.lit("\x1f"), F.coalesce(page, F.concat(F.lit("row "), F.col("row_no").cast("string"))))
    return table(spark, d, "page_index").select("row_no", "page_id", "doc_id", page.alias("page"), F.coalesce(paper("doc_id"), alone).alias("entity"), paper("doc_id").isNotNull().alias("named"))


def _shares(spark: SparkSession, d: str) -> dict[str, float]:
    return {r["split_name"]: r["target_share"] for r in fixed_rows(table(spark, d, "split_targets"), "split_targets")}


def _store(spark: SparkSession) -> ComponentStore:
    return ComponentStore(spark, new_table_path(spark, "page-components"))


def _split_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``page_index`` with their entities, read once, and the component table after all of them."""
    rows = stored(_entities(spark, d))
    return rows, _store(spark).update(rows, "entity", "page", _shares(spark, d)).nodes


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every row of ``page_index`` with its component and split."""
    rows, nodes = _split_rows(spark, d)
    known = nodes.select(F.col("node").alias("entity"), "component", "split")
    return merge_lookup(rows, known, "entity", F.col("row_no"), loads=key_loads(rows, "entity")[0]).select("row_no", "page_id", "doc_id", "component", "split")


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """The component table fed in two batches, before and after the middle of ``row_no``: each entity's component and split after either.

    ``first_split`` is null for entities of the second batch; known ones keep theirs, new ones of merged components of
    different splits are in quarantine, and ``conflict`` marks all of those.
    """
    rows = stored(_entities(spark, d))
    middle = rows.agg(((F.min("row_no") + F.max("row_no")) / 2).alias("m")).first()["m"]
    store, shares = _store(spark), _shares(spark, d)
    early = F.col("row_no") <= (middle or 0)
    before = store.update(rows.where(early), "entity", "page", shares).nodes
    after = store.update(rows.where(~early), "entity", "page", shares).nodes
    was = before.select("node", F.col("component").alias("first_component"), F.col("split").alias("first_split"))
    return after.join(was, "node", "left").select(F.col("node").alias("entity"), "first_component", "first_split", "component", "split", "conflict", "rows")


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of papers with the component of their entity."""
    rows, nodes = _split_rows(spark, d)
    spelled = rows.where("named").select("doc_id", "entity").distinct()
    return adaptive_lookup(spelled, nodes.select(F.col("node").alias("entity"), "component"), "entity", "inner")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the class of spellings that must share its split, and how many others are in it."""
    return related_classes(_members(spark, d), "doc_id", "component")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return related_pairs(_members(spark, d), "doc_id", "component").select("doc_id_a", "doc_id_b")


_P5_SQL = f"""WITH RECURSIVE held AS (SELECT doc_id, 'd' || {paper_sql('doc_id')} AS k FROM page_index WHERE {paper_sql('doc_id')} IS NOT NULL UNION SELECT doc_id, 'p' || page_id FROM page_index WHERE {paper_sql('doc_id')} IS NOT NULL AND trim(page_id) <> ''),
 link AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b USING (k) WHERE a.doc_id <> b.doc_id),
 walk AS (SELECT a, b FROM link UNION SELECT w.a, l.b FROM walk w JOIN link l ON l.a = w.b)"""


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict], float]:
    share = settings(spark, d)["mix_share"]
    sizes = token_sizes(table(spark, d, "documents"), "doc_id", label("source"), count_tokens)
    return sizes, plan_mix(sizes, table(spark, d, "mix_targets").withColumn("key", label("source")), share), share


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents in training order."""
    sizes, plan, _ = _mix(spark, d)
    return mix_documents(sizes, "doc_id", plan)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached, counted on the mixed table as it was written."""
    sizes, plan, share = _mix(spark, d)
    return mix_report(stored(mix_documents(sizes, "doc_id", plan), "mixed"), plan, share)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_report(spark, d).where("short").select("source").distinct()


def p8_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its shares of repeated content and the rules it breaks."""
    return repetition(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Out of the whole threshold table: every metric and rule is evaluated."""
    return p8_repetition(spark, d).where(F.array_contains("flags", "repeated_words")).select("doc_id")


_WORDS_SQL = r"regexp_extract_all(regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+')"
_P8_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
 g AS (SELECT doc_id, i, array_to_string(w[i:i+5], ' ') AS g FROM w, unnest(range(1, len(w) - 4)) AS r(i) WHERE len(w) >= 6),
 again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS nth FROM g) WHERE nth > 1),
 covered AS (SELECT doc_id, sum(least(6, coalesce(j - i, 6))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM again) GROUP BY doc_id)
SELECT doc_id FROM w JOIN covered USING (doc_id) WHERE n * 2 >= len(w)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_pages, p4_found, p4_sample, p4_report, p4_needs, p4_margins, p5_found, p5_splits, p5_classes, p5_batches, p6_ids, p7_found, p7_mix, p7_report, p8_found, p8_repetition)}
SQL = {
    "p1_found": f"SELECT page_id FROM ({_RANKED_SQL}) WHERE position > {_CAP_SQL}",
    "p1_pages": f"SELECT page_id, paper, score, position, position <= {_CAP_SQL} AS kept FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY score DESC NULLS LAST, page_id) AS position FROM {CURRENT_SQL} WHERE paper IS NOT NULL)",
    "p4_found": f"{_NEEDS_SQL} SELECT DISTINCT figure_family, difficulty FROM needs WHERE available < need",
    "p4_needs": f"{_NEEDS_SQL} SELECT figure_family, difficulty, need, available, least(need, available) AS own, need - least(need, available) AS slack FROM needs",
    "p5_found": f"{_P5_SQL} SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM walk WHERE a < b",
    "p8_found": _P8_SQL,
}
