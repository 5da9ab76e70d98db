"""Isotonic regression by mergeable convex-minorant hulls.

Put the scores in order and add up weight and label: the isotonic fit is the
slope of the greatest convex minorant of that path.  A minorant of a range of
scores is a list of edges (blocks of pooled scores) with rising slope, and the
minorants of two neighbouring ranges merge into one by pooling edges across the
seam.  So:

1. labels are added up by score (combined before the shuffle);
2. the scores are cut into ranges, and every range is reduced to its hull in one
   pass over its batches;
3. hulls are merged in a tree of tasks, ``FAN`` neighbours at a time.

A hull's blocks have strictly rising means.  With 0/1 labels a block of weight w
has one of w + 1 means, so n rows have at most about 2 n^(2/3) blocks: that, not
the number of scores, is what the last merge holds.  Weights and label sums are
whole numbers and slopes are compared by cross products, hence the fit is exact
and does not hang on the partitioning.

The blocks stay a table; scores meet them in a range join (``latest_mark``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cleaning import q
from .ranking import latest_mark

FAN = 8
_EDGES = "part int, lo double, hi double, w long, wy long"


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool neighbouring blocks whose means do not rise, until all do.

    A run of blocks with falling or equal means ends in one block whatever the
    order of pooling, so all runs are pooled at once; each round ends runs.
    """
    while len(w) > 1:
        a, b, c, d = wy[:-1], w[1:], wy[1:], w[:-1]
        if int(w.max()) * int(max(wy.max(), 1)) >= 2 ** 62:  # products beyond 64 bits: whole numbers of any size
            a, b, c, d = (x.astype(object) for x in (a, b, c, d))
        first = np.append(True, (a * b < c * d).astype(bool))
        if first.all():
            break
        at = np.flatnonzero(first)
        lo, hi = lo[at], hi[np.append(at[1:], len(hi)) - 1]
        w, wy = np.add.reduceat(w, at), np.add.reduceat(wy, at)
    return lo, hi, w, wy


def _columns(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [batch[c].to_numpy() for c in ("lo", "hi", "w", "wy")]


def _range_hull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hull of a partition's scores, which come in order."""
    hull = None
    for batch in batches:
        found = _columns(batch)
        hull = pool(*(found if hull is None else [np.concatenate(x) for x in zip(hull, found, strict=True)]))
    if hull is not None and len(hull[0]):
        part = np.full(len(hull[0]), TaskContext.get().partitionId(), dtype=np.int32)
        yield pa.record_batch([part, *hull], names=["part", "lo", "hi", "w", "wy"])


def _merged(table: pa.Table) -> list[np.ndarray]:
    """One hull from the hulls of neighbouring ranges."""
    found = _columns(table)
    order = np.argsort(found[0], kind="stable")
    return list(pool(*(x[order] for x in found)))


def _merge(table: pa.Table) -> pa.Table:
    hull = _merged(table)
    part = np.full(len(hull[0]), table["part"][0].as_py() // FAN, dtype=np.int32)
    return pa.table([part, *hull], names=["part", "lo", "hi", "w", "wy"])


def _finish(table: pa.Table) -> pa.Table:
    """The whole hull as marks: from where a block holds, its last score and mean, and the next block's."""
    lo, hi, w, wy = _merged(table)
    mean = wy / w
    shifted = lambda x: pa.array([*x[1:].tolist(), None], pa.float64())
    return pa.table({"at": np.append(-np.inf, lo[1:]), "lo": lo, "hi": hi, "w": w, "wy": wy, "mean": mean,
                     "next_lo": shifted(lo), "next_mean": shifted(mean)})


@dataclass
class IsotonicFit:
    """Blocks of a rising step function as a written table: at, lo, hi, w, wy, mean, next_lo, next_mean."""

    knots: DataFrame

    def transform(self, df: DataFrame, score: str, out: str) -> DataFrame:
        """``df`` with the fitted value of ``score``: a block's mean inside it, linear between blocks, level beyond the ends."""
        found = latest_mark(df, q(score).cast("double"), self.knots, "at", ["hi", "mean", "next_lo", "next_mean"], "_knot")
        x, k = q(score).cast("double"), F.col("_knot")
        between = k["mean"] + (x - k["hi"]) / (k["next_lo"] - k["hi"]) * (k["next_mean"] - k["mean"])
        return found.withColumn(out, F.when(x.isNull() | F.isnan(x), None).when((x <= k["hi"]) | k["next_lo"].isNull(), k["mean"]).otherwise(between)).drop("_knot")

    def save(self, path: str) -> None:
        self.knots.write.parquet(path)

    @classmethod
    def load(cls, path: str) -> IsotonicFit:
        return cls(SparkSession.getActiveSession().read.parquet(path))


def fit_isotonic(rows: DataFrame, score: str, label: str | Column, num_partitions: int | None = None) -> IsotonicFit:
    """Isotonic (rising) regression of a 0/1 label on a score; rows without either are left out."""
    y = q(label) if isinstance(label, str) else label
    points = (rows.select(q(score).cast("double").alias("lo"), y.cast("long").alias("wy"))
              .where("lo IS NOT NULL AND NOT isnan(lo) AND wy IS NOT NULL")
              .groupBy("lo").agg(F.count(F.lit(1)).alias("w"), F.sum("wy").alias("wy"))
              .select("lo", F.col("lo").alias("hi"), "w", "wy"))
    n = num_partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    hulls = points.repartitionByRange(n, "lo").sortWithinPartitions("lo").mapInArrow(_range_hull, _EDGES)
    while n > FAN:
        hulls = hulls.groupBy((F.col("part") / FAN).cast("int").alias("parent")).applyInArrow(_merge, _EDGES)
        n = -(-n // FAN)
    marks = hulls.groupBy(F.lit(0).alias("all")).applyInArrow(
        _finish, "at double, lo double, hi double, w long, wy long, mean double, next_lo double, next_mean double")
    return IsotonicFit(cut_lineage(marks))
