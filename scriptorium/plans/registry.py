"""Registry of named queries and their DuckDB oracle statements.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the given tables;
``oracle`` holds the equivalent DuckDB SQL where one exists.  Modules under
``scriptorium.plans`` register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    from scriptorium.plans import (  # noqa: F401
        q_corpus, q_edges, q_excerpts, q_retrieval, q_search, q_scoring, q_text,
    )


def _with_package(fn: QueryFn) -> QueryFn:
    import functools

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from scriptorium.session import ship_package
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def queries() -> dict[str, QueryFn]:
    load_all()
    return {name: _with_package(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
