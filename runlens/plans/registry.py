"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` per key, plus the
DuckDB oracle SQL for the same result where SQL can express it.

Every query reads the driver's tables (or views Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = with_views(oracle.strip())
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module so the registry is filled."""
    from . import (q_classify, q_healing, q_ingest, q_ml, q_runs, q_stats, q_streaming,  # noqa: F401
                   q_timeseries, q_vcs)
