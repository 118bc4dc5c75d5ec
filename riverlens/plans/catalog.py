"""Registry of named queries: a Spark builder and (where SQL can say it) an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from . import queries_alerts, queries_features, queries_metrics, queries_models, queries_quality, queries_sources, queries_streaming, queries_survey  # noqa: F401
