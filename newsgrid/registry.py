"""Queries over the coded-event tables by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsgrid.sources import adapter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_NAMES = {n: n for n in (*adapter.TABLES, "orders")}
FACT_SQL = adapter.FACT.format(**_NAMES)
PACKED_SQL = FACT_SQL + adapter.PACKED
MENTIONS_SQL = FACT_SQL + adapter.MENTIONS.format(**_NAMES)
CONTEXT_SQL = PACKED_SQL + adapter.MENTIONS.format(**_NAMES)
SERIES_SQL = adapter.SERIES.format(**_NAMES)


def query(name: str, sql: str | None = None, over: str | None = None):
    """Register a query of (spark, sf_dir), or of one derived table: over is fact, packed, mentions or series.

    sql is DuckDB's text for the same rows; over a derived table it continues that table's WITH list or begins with SELECT.
    """
    heads = {"fact": FACT_SQL, "packed": PACKED_SQL, "mentions": MENTIONS_SQL, "series": f"WITH series AS ({SERIES_SQL})"}
    frames = {"fact": adapter.fact, "packed": adapter.packed, "mentions": adapter.mentions, "series": adapter.daily_series}

    def register(f):
        QUERIES[name] = f if over is None else lambda spark, sf_dir: f(frames[over](spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql if over is None else f"{heads[over]}\n{sql}"
        return f

    return register


def mean_sql(x: str, digits: int = 1) -> str:
    """As functions.scalars.mean."""
    return f"CAST(SUM(CAST(ROUND({x} * {10**digits}) AS BIGINT)) AS BIGINT) / (COUNT({x}) * {10.0**digits})"


def count_sql(condition: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


from newsgrid.plans import analysis, events, extra, forecasting, ingest, lookup, more, reports, rollups, served, texts, context, trees, names  # noqa: E402, F401
