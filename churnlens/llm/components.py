"""Connected components by alternating large-star and small-star steps, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node sends its larger (large) or smaller (small) neighbours to its least neighbour."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that the join below has a shuffle on both sides and a hot node can be split
    least = cut_lineage(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    sent = near.join(least, "a")
    if large:
        out = sent.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = sent.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that has an edge, with the least node of its component."""
    cast = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = cut_lineage(cast.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
    mark = tuple(print_of(now))
    while mark[0]:
        now = cut_lineage(_star(cut_lineage(_star(now, large=True)), large=False))
        before, mark = mark, tuple(print_of(now))
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
