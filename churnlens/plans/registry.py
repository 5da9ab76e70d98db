"""Registry of named queries over the driver test tables.

Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where the
operator is SQL-expressible, a DuckDB oracle text over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Parameters for the driver tables: their orders span 1995-2001 (so the
# cohort start moves back) and few customers reach 12 months after a restart.
TESTDATA_PARAMS = {"retain_min": 6, "churn_range": (1, 6), "since": "1995-01-01"}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (they register on import)."""
    from . import queries_cohort  # noqa: F401
    from . import queries_model  # noqa: F401
    from . import queries_segments  # noqa: F401
    from . import queries_features  # noqa: F401
    from . import queries_labels  # noqa: F401
