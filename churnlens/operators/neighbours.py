"""Exact k nearest neighbours by a metric partition.

1. Pivots: a bounded number of vectors, chosen by a hash.  Every vector belongs to
   the cell of its nearest pivot; a cell knows its radius.
2. A cell is cut into rings of ``block`` to 2 * ``block`` vectors by distance from
   its pivot (range-partitioned ranks, so a cell may hold any share of the rows).
3. Every vector searches its own ring first.  Its k-th distance there, or the
   least radius round whole cells that surely holds k others, bounds what is left.
4. By the triangle inequality a cell is out of reach if its pivot is farther than
   bound + radius, or farther than the own pivot by twice the bound; a ring is out
   of reach if its distances from the pivot differ by more than the bound.  Only
   rings within reach are searched, in groups of (ring, chunk of vectors).

Bounds are widened by a rounding allowance, so the result is that of comparing all
pairs; ties go to the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cleaning import q
from .ranking import rank_within_groups

MOST_PIVOTS, BLOCK, CHUNK = 1024, 512, 4096
_SLACK = 1e-9
_FOUND = "_vk string, _d double, _nvk string, _avail long"


def _points(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.stack(column.to_numpy())


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row for each vector of ``a``; differences are squared as they are, so equal vectors are exactly 0 apart."""
    return np.sqrt(((b[None, :, :] - a[:, None, :]) ** 2).sum(axis=2))


def _sliced(n: int, width: int, dims: int) -> Iterator[slice]:
    """Slices of ``n`` rows whose differences to ``width`` vectors take about 32 MB."""
    step = max(1, (1 << 22) // max(1, width * dims))
    return (slice(s, s + step) for s in range(0, n, step))


def _nearest(keys: np.ndarray, a: np.ndarray, within: np.ndarray, other: np.ndarray, b: np.ndarray, mult: np.ndarray, k: int) -> pd.DataFrame:
    """For each vector of ``a`` the nearest of ``b`` that make up k rows, not beyond ``within``."""
    parts = []
    order_of = np.argsort(other, kind="stable")  # by key: a stable order of distances then breaks ties
    other, b, mult = other[order_of], b[order_of], mult[order_of]
    for s in _sliced(len(a), len(b), a.shape[1]):
        d = _distances(a[s], b)
        for vk, row, most in zip(keys[s], d, within[s], strict=True):
            near = np.flatnonzero(row <= most)
            if len(near) > 4 * k + 1:  # the k + 1 nearest vectors hold k rows besides the vector itself
                near = near[row[near] <= np.partition(row[near], k)[k]]
            near = near[np.argsort(row[near], kind="stable")]
            avail = np.where(other[near] == vk, mult[near] - 1, mult[near])  # a row is not its own neighbour
            near, avail = near[avail > 0], avail[avail > 0]
            need = int(np.searchsorted(np.cumsum(avail), k)) + 1
            near, avail = near[:need], avail[:need]
            parts.append(pd.DataFrame({"_vk": vk, "_d": row[near], "_nvk": other[near], "_avail": avail}))
    return pd.concat(parts) if parts else pd.DataFrame({"_vk": [], "_d": [], "_nvk": [], "_avail": []})


def _place(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """_cell (nearest pivot) and _dist of every vector."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # at most ``MOST_PIVOTS`` vectors

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _points(batch.column("_x"))
            cell, dist = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
            for s in _sliced(len(x), len(sent.value), x.shape[1] if len(x) else 1):
                d = _distances(x[s], sent.value)
                cell[s] = d.argmin(axis=1)
                dist[s] = d.min(axis=1)
            yield batch.append_column("_cell", pa.array(cell)).append_column("_dist", pa.array(dist))

    return rows.mapInArrow(placed, "_vk string, _mult long, _x array<double>, _cell int, _dist double")


def _reach(rows: DataFrame, pivots: np.ndarray, cells: pd.DataFrame, k: int) -> DataFrame:
    """Every (vector, cell) within reach, with the vector's distance from the cell's pivot and its bound."""
    radius, held = np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    radius[cells["_cell"]], held[cells["_cell"]] = cells["_radius"], cells["_rows"]
    sent = rows.sparkSession.sparkContext.broadcast((pivots, radius, held))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, radius, held = sent.value
        for batch in batches:
            x, bound = _points(batch.column("_x")), batch.column("_kth").to_numpy(zero_copy_only=False)
            for s in _sliced(len(x), len(at), x.shape[1] if len(x) else 1):
                d = _distances(x[s], at)
                whole = np.where(held > 0, d + radius, np.inf)  # all rows of the cell are within
                order = np.argsort(whole, axis=1)
                enough = (np.cumsum(held[order], axis=1) > k).argmax(axis=1)  # k rows besides the vector itself
                sure = np.take_along_axis(whole, order, axis=1)[np.arange(len(d)), enough]
                most = np.fmin(bound[s], sure)
                most = most * (1 + _SLACK) + _SLACK * d.max(axis=1)
                far = (d - radius > most[:, None]) | (d - d.min(axis=1)[:, None] > 2 * most[:, None]) | (held == 0)
                row, cell = np.nonzero(~far)
                own = batch.slice(s.start, len(d)).take(pa.array(row))
                yield pa.record_batch([own.column("_vk"), own.column("_x"), own.column("_cell"), own.column("_ring"), cell.astype(np.int32), d[row, cell], most[row]],
                                      names=["_vk", "_x", "_home", "_home_ring", "_cell", "_from", "_most"])

    return rows.mapInArrow(within, "_vk string, _x array<double>, _home int, _home_ring long, _cell int, _from double, _most double")


def nearest_neighbours(vecs: DataFrame, features: Sequence[str], k: int, block: int = BLOCK, most_pivots: int = MOST_PIVOTS,
                       trace: dict | None = None) -> DataFrame:
    """(_vk, _nr, _nvk): the k nearest neighbours, with multiplicity, of every distinct vector.

    ``vecs`` has _vk, _mult and the features; together the multiplicities must
    exceed k.  ``trace`` receives the number of vectors and of pairs compared.
    """
    narrow = vecs.select("_vk", F.col("_mult").cast("long").alias("_mult"), F.array(*[q(c).cast("double") for c in features]).alias("_x"))
    n = narrow.count()
    chosen = narrow.orderBy(F.xxhash64("_vk"), "_vk").limit(max(1, min(most_pivots, math.isqrt(n))))
    pivots = np.array([r["_x"] for r in chosen.collect()], dtype=float)
    at_cell = cut_lineage(_place(narrow, pivots))
    cells = at_cell.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_mult").alias("_rows"), F.max("_dist").alias("_radius"))
    cells = cells.toPandas()  # one row for each pivot at most

    ranked = rank_within_groups(at_cell, "_cell", [F.col("_dist"), F.col("_vk")], "_pos")
    size = F.broadcast(vecs.sparkSession.createDataFrame(cells[["_cell", "_n"]], "_cell int, _n long"))
    rings = F.greatest(F.floor(F.col("_n") / block), F.lit(1))
    placed = cut_lineage(ranked.join(size, "_cell").withColumn("_ring", F.floor((F.col("_pos") - 1) * rings / F.col("_n")).cast("long")).drop("_pos", "_n"))
    units = cut_lineage(placed.groupBy("_cell", "_ring").agg(F.min("_dist").alias("_lo"), F.max("_dist").alias("_hi"), F.count(F.lit(1)).alias("_n")))

    def at_home(rows: pd.DataFrame) -> pd.DataFrame:
        x, keys = _points(rows["_x"]), rows["_vk"].to_numpy()
        return _nearest(keys, x, np.full(len(x), np.inf), keys, x, rows["_mult"].to_numpy(), k)

    home = cut_lineage(placed.groupBy("_cell", "_ring").applyInPandas(at_home, _FOUND))
    kth = home.groupBy("_vk").agg(F.max("_d").alias("_d"), F.sum("_avail").alias("_have")).where(F.col("_have") >= k).select("_vk", F.col("_d").alias("_kth"))
    near = _reach(placed.join(kth, "_vk", "left").select("_vk", "_x", "_cell", "_ring", "_kth"), pivots, cells, k)
    own = (F.col("_home") == F.col("_cell")) & (F.col("_home_ring") == F.col("_ring"))
    seen = (F.col("_from") - F.col("_hi") <= F.col("_most")) & (F.col("_lo") - F.col("_from") <= F.col("_most"))
    pairs = cut_lineage(near.join(units, "_cell").where(seen & ~own).select("_vk", "_x", "_most", "_cell", "_ring", F.col("_n")))
    if trace is not None:
        at = units.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 0
        trace |= {"vectors": n, "pairs": at + (pairs.agg(F.sum("_n")).first()[0] or 0)}

    chunks = cut_lineage(pairs.groupBy("_cell", "_ring").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_chunks")))
    asked = pairs.join(chunks, ["_cell", "_ring"]).withColumn("_chunk", F.pmod(F.xxhash64("_vk"), F.col("_chunks")))
    held = placed.join(chunks, ["_cell", "_ring"]).select(
        F.col("_vk").alias("_hvk"), F.col("_x").alias("_hx"), F.col("_mult").alias("_hmult"), F.col("_cell").alias("_hcell"), F.col("_ring").alias("_hring"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_hchunk"))

    def abroad(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asking.empty or held.empty:
            return pd.DataFrame({"_vk": [], "_d": [], "_nvk": [], "_avail": []})
        return _nearest(asking["_vk"].to_numpy(), _points(asking["_x"]), asking["_most"].to_numpy(), held["_hvk"].to_numpy(),
                        _points(held["_hx"]), held["_hmult"].to_numpy(), k)

    away = asked.groupBy("_cell", "_ring", "_chunk").cogroup(held.groupBy("_hcell", "_hring", "_hchunk")).applyInPandas(abroad, _FOUND)
    # k entries hold k rows; the limit is applied before the shuffle and again after it
    best = Window.partitionBy("_vk").orderBy("_d", "_nvk")
    found = home.unionByName(away).withColumn("_nr", F.row_number().over(best)).where(F.col("_nr") <= k)
    rows_each = Window.partitionBy("_vk").orderBy("_nr").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_before", F.coalesce(F.sum("_avail").over(rows_each), F.lit(0))).where(F.col("_before") < k)
    last = F.least(F.col("_before") + F.col("_avail"), F.lit(k))
    return found.select("_vk", F.explode(F.sequence((F.col("_before") + 1).cast("int"), last.cast("int"))).alias("_nr"), "_nvk")
