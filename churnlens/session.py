"""Spark session and checkpoint-directory helpers.

The library never hard-codes a cluster path.  ``ensure_checkpoint_dir`` reads
``spark.checkpoint.dir`` from the session; only when it is unset (local tests)
does it create a scratch directory.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "churnlens") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    cores = os.cpu_count() or 8
    builder = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHURNLENS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, creating a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share "
                             "(stage hand-offs and ranks are written there)")
        # Local runs and tests only: a cluster names a shared folder here.
        configured = tempfile.mkdtemp(prefix="churnlens-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return configured


def shared_root(spark: SparkSession) -> str:
    """The folder that outlives the session: ``spark.checkpoint.dir`` itself, or the parent of the session's own folder."""
    own = ensure_checkpoint_dir(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (configured or os.path.dirname((spark.sparkContext.getCheckpointDir() or own).rstrip("/"))).rstrip("/")


_WRITTEN: dict[str, list[str]] = {}


def remove_tables(spark: SparkSession) -> None:
    """Delete the hand-off tables that ``cut_lineage`` wrote in this session.

    Call it in a long-lived session when no result that reads them is needed any
    more; it also runs when the driver program ends with the session still open.
    """
    sc = spark.sparkContext
    for path in _WRITTEN.pop(sc.applicationId, []):
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        remove_tables(spark)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, let_go: bool = False) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    The result survives executor loss (the files are on the shared store),
    and, unlike ``DataFrame.checkpoint``'s serialized rows, later readers get
    column pruning and filter pushdown on it.  With ``let_go`` Spark deletes the
    shuffle files of ``df``, which is not to be executed again, once it is written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.unregister(_remove_at_exit)
        atexit.register(_remove_at_exit)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(_CLEANUP, None)
    if let_go:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if let_go and before is None:
            spark.conf.unset(_CLEANUP)
        elif let_go:
            spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


def at_once(*builders: Callable[[], T]) -> list[T]:
    """The results of independent builders, whose jobs run side by side (each in a thread of its own)."""
    inherit = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(len(builders)) as pool:
        return [f.result() for f in [pool.submit(inherit(b)) for b in builders]]
