"""Registration of queries: a name, a callable of (session, data folder), and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common table expressions of the canonical relations, for SQL.
RELATIONS = {
    "cells": "cells AS (SELECT vec_id AS sample_id, label, p // 8 AS y, p % 8 AS x, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(p))",
    "channels": "channels AS (SELECT vec_id AS sample_id, p // 16 AS c, (p % 16) // 4 AS y, p % 4 AS x, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(p))",
    "ensemble": "ensemble AS (SELECT label AS sample_id, realization, p // 8 AS y, p % 8 AS x, CAST(embedding[p + 1] AS DOUBLE) AS v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS realization FROM embeddings), range(64) r(p))",
    "series": "series AS (SELECT user_id AS sample_id, event_type AS c, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t, value AS y FROM events)",
    "user_series": "user_series AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS y FROM events)",
    "daily": "daily AS (SELECT event_type AS c, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, avg(value) AS y FROM events GROUP BY ALL)",
    "features": "features AS (SELECT vec_id AS sample_id, label, p AS feature, CAST(embedding[p + 1] AS DOUBLE) AS value FROM embeddings, range(64) r(p))",
    "codebook": "codebook AS (SELECT label AS code, p AS feature, avg(CAST(embedding[p + 1] AS DOUBLE)) AS e FROM embeddings, range(64) r(p) GROUP BY ALL)",
}


def with_relations(*names: str) -> str:
    return "WITH " + ",\n".join(RELATIONS[n] for n in names)


def r(expression: str, digits: int = 6) -> str:
    """SQL that rounds, without a negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with DuckDB SQL for its result."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
