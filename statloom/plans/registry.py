"""All queries of the core library and their SQL."""

from __future__ import annotations

from statloom.plans import access, chains, evaluation, pipeline, problems, retrieval, unified

MODULES = (problems, retrieval, evaluation, pipeline, unified, chains, access)

flagship = retrieval.keyword_retrieve


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
