"""Every registered query of the panel library with the SQL that it is held against."""

from __future__ import annotations

from . import compare_queries, feature_queries, more_queries, operator_queries, profile_queries, storage_queries

ALL = [*operator_queries.QUERIES, *feature_queries.QUERIES, *compare_queries.QUERIES, *more_queries.QUERIES, *profile_queries.QUERIES, *storage_queries.QUERIES]


def queries() -> dict:
    return {q.name: q.run for q in ALL}


def oracle_sql() -> dict:
    return {q.name: sql for q in ALL if (sql := q.oracle())}
