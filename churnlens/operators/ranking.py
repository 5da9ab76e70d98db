"""Global ordering without a single-task window.

``Window.orderBy(...)`` with no partition key moves every row into one task.
Here the frame is range-partitioned on the order key (ties split by the
unique id, so a hot value is spread over many partitions), sorted inside each
partition and written once to the shared checkpoint folder, so the count pass
and the numbering pass see the same partitions even after executor loss.
Per-partition counts/totals form a table with one row per partition -- its
size is bounded by the partition count, not the data -- and are turned into
offsets that are broadcast back.

Every frame takes this path, whatever its size.  The written rows are the
order columns and what the caller keeps, so callers rank narrow (id, key) rows
and join wide columns or texts back by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PID, _MID, _OFF = "_rk_pid", "_rk_mid", "_rk_off"


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _ranged(df: DataFrame, order: Sequence[Column], num_partitions: int | None) -> DataFrame:
    n = _num_partitions(df, num_partitions)
    tagged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    return cut_lineage(tagged)


def _offsets(ranged: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Exclusive running totals over partitions (one row per partition)."""
    per_part = ranged.groupBy(_PID).agg(*[c.alias(k) for k, c in totals.items()])
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(_PID, *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(_OFF + k)
                                   for k in totals])


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the total order ``order`` (which must be unique,
    i.e. end with a tie-breaking id), like a 'first'-method rank."""
    ranged = _ranged(df, order, num_partitions)
    offsets = _offsets(ranged, {"n": F.count(F.lit(1))})
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (ranged.join(F.broadcast(offsets), _PID)
            .withColumn(rank_col, (F.col(_OFF + "n") + local + 1).cast("long"))
            .drop(_PID, _MID, _OFF + "n"))


def prefix_sums(df: DataFrame, order: Sequence[Column], value_cols: Sequence[str],
                suffix: str = "_cum", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``value_cols`` along the total order ``order``."""
    ranged = _ranged(df, order, num_partitions)
    offsets = _offsets(ranged, {v: F.sum(v) for v in value_cols})
    w = (Window.partitionBy(_PID).orderBy(_MID)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranged.join(F.broadcast(offsets), _PID)
    out = out.select("*", *[(F.col(_OFF + v) + F.sum(v).over(w)).alias(v + suffix)
                            for v in value_cols])
    return out.drop(_PID, _MID, *[_OFF + v for v in value_cols])


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                    buckets: int | None = None, salt_key: Column | None = None,
                    rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group in ``order`` (which must be a total order).

    Two phases keep a hot group from landing in one task: first the top ``n``
    inside each (group, hash bucket) -- a large group is spread over
    ``buckets`` tasks -- then the top ``n`` of those at most ``n * buckets``
    candidates per group.  The result is exact because a group's top ``n``
    is contained in the union of its buckets' top ``n``.  ``buckets`` defaults
    to the session's shuffle partition count, so a cluster sized for its data
    also sizes the split of a hot group.
    """
    buckets = buckets or _num_partitions(df, None)
    salt = F.pmod(F.xxhash64(salt_key if salt_key is not None else F.struct(*df.columns)), F.lit(buckets))
    gcols = [F.col(g) for g in group]
    w1 = Window.partitionBy(*gcols, F.col("_salt")).orderBy(*order)
    cand = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
            .filter(F.col("_r1") <= n).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*gcols).orderBy(*order)
    return cand.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= n)


def rank_within_groups(df: DataFrame, group: str, order: Sequence[Column], rank_col: str = "pos",
                       num_partitions: int | None = None) -> DataFrame:
    """1-based position of every row inside its group, for groups of any size, null group included.

    The rows are range-partitioned on (group, order), so a hot group is cut into
    many tasks and only a partition's first group can have begun before it.  A
    row's position is its place among its group's rows in the partition, plus,
    for that first group, the rows it has in the partitions before: a table of
    one row per partition.  No join on the group is needed.
    """
    g = f"`{group}`"
    ranged = _ranged(df, [F.col(g), *order], num_partitions)
    parts = ranged.groupBy(_PID, F.col(g).alias("_g")).agg(F.count(F.lit(1)).alias("n"), F.min(_MID).alias("at"))
    parts = parts.groupBy(_PID).agg(F.min(F.struct("at", "_g")).alias("first"), F.max(F.struct("at", "_g", "n")).alias("last"))
    by_part = Window.orderBy(_PID)
    of_group = Window.partitionBy("last._g").orderBy(_PID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (parts.withColumn("_run", F.sum("last.n").over(of_group))
              .withColumn("_seen", F.lag("_run").over(by_part)).withColumn("_prev", F.lag("last").over(by_part)))
    goes_on = F.col("_prev").isNotNull() & F.col("first._g").eqNullSafe(F.col("_prev._g"))
    offsets = before.select(_PID, F.col("first._g").alias("_first"),
                            F.when(goes_on, F.col("_seen")).otherwise(0).alias(_OFF))
    own = Window.partitionBy(_PID, F.col(g))  # at most one partition's rows
    local = F.col(_MID) - F.min(_MID).over(own)
    carried = F.when(F.col(g).eqNullSafe(F.col("_first")), F.col(_OFF)).otherwise(0)
    return (ranged.join(F.broadcast(offsets), _PID)
            .withColumn(rank_col, (local + carried + 1).cast("long"))
            .drop(_PID, _MID, _OFF, "_first"))


def totals_before(df: DataFrame, group: Sequence[str], order: Sequence[Column], value_cols: Sequence[str],
                  suffix: str = "_before", num_partitions: int | None = None) -> DataFrame:
    """``df`` with the sums of ``value_cols`` over the rows before each one in its group, for groups of any size.

    ``order`` must be total inside a group; null group values are a group.  As in
    ``rank_within_groups`` only a partition's first group can have begun before
    it, and what it brings along comes from a table of one row per partition.
    """
    g = F.struct(*[F.col(f"`{c}`") for c in group])
    ranged = _ranged(df, [*[F.col(f"`{c}`") for c in group], *order], num_partitions)
    sums = [F.sum(f"`{v}`").alias(f"_s{i}") for i, v in enumerate(value_cols)]
    totals = [f"_s{i}" for i in range(len(value_cols))]
    parts = ranged.groupBy(_PID, g.alias("_g")).agg(F.min(_MID).alias("at"), *sums)
    parts = parts.groupBy(_PID).agg(F.min(F.struct("at", "_g")).alias("first"), F.max(F.struct("at", "_g", *totals)).alias("last"))
    by_part = Window.orderBy(_PID)  # one row per partition
    of_group = Window.partitionBy("last._g").orderBy(_PID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = parts.select("*", F.struct(*[F.sum(f"last.{t}").over(of_group).alias(t) for t in totals]).alias("_run"))
    seen = run.select("*", F.lag("_run").over(by_part).alias("_seen"), F.lag("last").over(by_part).alias("_prev"))
    goes_on = F.col("_prev").isNotNull() & F.col("first._g").eqNullSafe(F.col("_prev._g"))
    offsets = seen.select(_PID, F.col("first._g").alias("_first"), F.when(goes_on, F.col("_seen")).alias("_seen"))
    inside = Window.partitionBy(_PID, *[F.col(f"`{c}`") for c in group]).orderBy(_MID).rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda t: F.when(g.eqNullSafe(F.col("_first")), F.coalesce(F.col(f"_seen.{t}"), F.lit(0))).otherwise(0)
    out = ranged.join(F.broadcast(offsets), _PID)
    out = out.withColumns({v + suffix: F.coalesce(F.sum(f"`{v}`").over(inside), F.lit(0)) + carried(t) for v, t in zip(value_cols, totals)})
    return out.drop(_PID, _MID, "_first", "_seen")


def latest_mark(rows: DataFrame, key: Column, marks: DataFrame, at: str, take: Sequence[str], out: str,
                num_partitions: int | None = None) -> DataFrame:
    """``rows`` with the struct ``out``: columns ``take`` of the last mark whose ``at`` is not above ``key`` (null: none is).

    A range join without comparing rows with ranges: rows and marks are put in
    one order, cut into ranges (equal keys split by a running number, so a hot
    key is many tasks' work) and written once; a row takes the last mark before
    it in its partition, or else the last mark of the partitions before.  Marks
    must have distinct ``at``; rows with a null key get null.
    """
    mark = F.struct(*[F.col(c) for c in take])
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    none = lambda c, df: F.lit(None).cast(df.select(c.alias("c")).schema["c"].dataType)
    both = (marks.select(F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"), mark.alias("_mark"), none(row, rows).alias("_row"))
            .unionByName(rows.select(key.alias("_at"), F.lit(1).alias("_kind"), F.monotonically_increasing_id().alias("_tie"),
                                     none(mark, marks).alias("_mark"), row.alias("_row"))))
    ranged = _ranged(both, [F.col("_at"), F.col("_kind"), F.col("_tie")], num_partitions)
    last = ranged.where("_kind = 0").groupBy(_PID).agg(F.max_by("_mark", _MID).alias("_end"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = ranged.groupBy(_PID).agg(F.lit(1)).select(_PID).join(last, _PID, "left").select(_PID, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(_PID).orderBy(_MID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.join(F.broadcast(carried), _PID).withColumn(out, F.coalesce(F.last("_mark", ignorenulls=True).over(inside), F.col("_carried")))
    found = found.where("_kind = 1").withColumn(out, F.when(F.col("_at").isNotNull(), F.col(out)))
    return found.select("_row.*", out)
