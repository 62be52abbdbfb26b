"""All queries of the core and their SQL."""

from __future__ import annotations

from pagefold.plans import candidate_queries, curation_queries, dataset_queries, instance_queries, layout_queries, page_queries, report_queries, score_queries

MODULES = (layout_queries, candidate_queries, page_queries, score_queries, instance_queries, report_queries, dataset_queries, curation_queries)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
