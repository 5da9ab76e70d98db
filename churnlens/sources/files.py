"""File sources and sinks: CSV with quoted multi-line text, parquet by default.

Exports go under the session's checkpoint folder (the shared location a
cluster names in ``spark.checkpoint.dir``), never to a machine-local path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8"}


def export_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one export under the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header, quoted fields (embedded quotes doubled, newlines kept), one file per task."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read CSV written by ``write_csv`` or a spreadsheet export (BOM tolerated).

    With a schema the types are fixed; without one every column is a string
    (no inference pass over the data).  Quoted line ends make a CSV file
    unsplittable, so a file is read by one task: hand-offs inside the library
    are parquet, CSV is for exports, which have one file per writing task.
    """
    reader = spark.read.options(**CSV_OPTIONS)
    if schema:
        reader = reader.schema(schema)
    return reader.csv(path)


def write_counted(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> int:
    """Write ``df`` and return its row count, observed during the write (no extra pass)."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    obs = Observation("rows_written")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if fmt == "csv":
        write_csv(observed, path, mode)
    else:
        observed.write.mode(mode).format(fmt).options(**({"compression": "zstd"} if fmt == "parquet" else {})).save(path)
    return int(obs.get["rows"])


def run_query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text over named DataFrames (registered as temporary views); lazy."""
    for name, frame in (views or {}).items():
        frame.createOrReplaceTempView(name)
    return spark.sql(sql)
