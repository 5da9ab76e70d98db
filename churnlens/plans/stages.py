"""Stage outputs shared by the registered queries.

The pipeline has hand-off points (wide row, cohort rows, enriched/model rows,
churn rows for segmentation).  Each is a committed table in the folder the
session names in ``spark.checkpoint.dir`` (``handoff``): later stages, and later
sessions over the same inputs, read the written rows instead of re-running the
cohort plan, and a lost executor re-reads files instead of recomputing the whole
history.  Fitted models are remembered by the driver for its session.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .handoff import write_once
from .registry import TESTDATA_PARAMS

_MEMO: dict[tuple[str, str, str], Any] = {}


def _session_key(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def remembered(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], Any]) -> Any:
    """``build()`` for this session and folder, called once."""
    key = (_session_key(spark), sf_dir.rstrip("/"), name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def materialised(spark: SparkSession, sf_dir: str, name: str,
                 build: Callable[[], DataFrame], write: bool = True) -> DataFrame:
    """The stage ``name`` over the tables of a folder: a hand-off, found or built once.

    ``write=False`` is for builders that already end in a written table
    followed only by cheap row filters, so a second write would buy nothing.
    """
    if not write:
        return remembered(spark, sf_dir, name, build)
    return remembered(spark, sf_dir, name, lambda: write_once(spark, sf_dir, name, build, TESTDATA_PARAMS).read(spark))


def forget(spark: SparkSession | None = None) -> None:
    """Drop everything remembered (of all sessions, or of one): stages, fitted models, centres."""
    if spark is None:
        _MEMO.clear()
        return
    app = _session_key(spark)
    for k in [k for k in _MEMO if k[0] == app]:
        del _MEMO[k]
