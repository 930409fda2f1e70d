"""Registry of named queries and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
given tables.  The oracle is SQL over the same parquet files; computed columns
carry the same alias on both sides.  Oracles of drawn specs share the draws and
the text stages with the operators (one expression, two dialects); the rules and
sentences themselves are checked against hand-made goldens in ``tests``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn`` under ``name``; ``oracle`` is DuckDB SQL (omit for rows-only checks)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def duck_h(key_sql: str) -> str:
    """DuckDB spelling of ``h``: first 32 bits of MD5 as BIGINT."""
    return f"(('0x' || substr(md5({key_sql}), 1, 8))::BIGINT)"


def duck_key(*parts: str) -> str:
    """DuckDB ``concat_ws('|', ...)``; parts are SQL expressions."""
    return "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
