"""Registered queries: one per operator key, each paired with DuckDB SQL.

Every query reads the driver's tables (through the fixture adapters) in full
and returns scalar columns; doubles are rounded to 6 decimals in both engines
so the value hash compares like with like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query and (when SQL-expressible) its DuckDB oracle."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    """Import the query modules (they register themselves)."""
    from . import (q_accounts, q_bars, q_news, q_pipeline, q_profiling,  # noqa: F401
                   q_prompts, q_windows)
