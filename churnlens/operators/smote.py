"""SMOTE oversampling of the minority class, exact and distributed.

k nearest neighbours are searched among the *distinct* minority feature vectors
(with multiplicities), so duplicates cost nothing.  The search is exact and prunes
by a metric partition (``neighbours``), without a bound on the number of vectors.

Synthetic rows come from ``explode(sequence)`` per minority row: how many per row
from a range-partitioned rank of a seeded hash (exact total), which neighbour and
which gap from seeded hashes, so the result is reproducible and independent of
partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cleaning import q
from .neighbours import BLOCK, nearest_neighbours
from .ranking import global_rank

_TWO63 = 9223372036854775808.0


def _vector_key(features: Sequence[str]):
    return F.md5(F.concat_ws("|", *[q(c).cast("double").cast("string") for c in features]))


def _unit(*cols) -> F.Column:
    """Uniform [0, 1) from a seeded 64-bit hash."""
    return (F.abs(F.xxhash64(*cols).cast("double")) / F.lit(_TWO63))


def smote(df: DataFrame, features: Sequence[str], label: str, key: str = "row_id", k: int = 5,
          seed: int = 42, block: int = BLOCK, trace: bool = False) -> DataFrame:
    """Return ``df`` plus synthetic minority rows (``synthetic`` = 1) until the classes balance.

    Features must be imputed (no nulls).  Synthetic rows get key
    ``<base key>#s<j>`` and keep every non-feature column of their base row.
    ``trace`` adds smote_base, smote_gap and smote_neighbour (its features), null on given rows.
    """
    features = list(features)
    counts = {int(r[0]): int(r[1]) for r in df.groupBy(q(label)).count().collect()}
    if len(counts) != 2:
        raise ValueError(f"SMOTE needs two classes, got {sorted(counts)}")
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    n_min, n_new = counts[minority], counts[majority] - counts[minority]
    df = df.withColumns({c: q(c).cast("double") for c in features})
    base = df.withColumn("synthetic", F.lit(0))
    if trace:
        base = base.withColumns({"smote_base": F.lit(None).cast("string"), "smote_gap": F.lit(None).cast("double"),
                                 "smote_neighbour": F.lit(None).cast("array<double>")})
    if n_new <= 0:
        return base
    if n_min <= k:
        raise ValueError(f"SMOTE needs more than k={k} minority rows, got {n_min}")

    mino = df.filter(q(label) == minority).withColumn("_vk", _vector_key(features))
    vecs = cut_lineage(mino.groupBy("_vk").agg(*[F.first(q(c)).cast("double").alias(c) for c in features],
                                               F.count(F.lit(1)).alias("_mult")))
    nbrs = nearest_neighbours(vecs, features, k, block)
    nbr_vecs = nbrs.join(vecs.select(F.col("_vk").alias("_nvk"), F.array(*[q(c) for c in features]).alias("_n")), "_nvk")

    # rows per base: n_new // n_min each, one more for the first (n_new % n_min) in hash order
    per, extra = divmod(n_new, n_min)
    narrow = mino.select(q(key).alias("_rk"), F.xxhash64(q(key), F.lit(seed)).alias("_h"))
    ranked = global_rank(narrow, [F.col("_h"), F.col("_rk")], "_pos").select("_rk", "_pos")
    plan = (mino.join(ranked, q(key) == F.col("_rk")).drop("_rk")
            .withColumn("_cnt", F.lit(per) + (F.col("_pos") <= extra).cast("int")).filter("_cnt > 0"))
    gen = plan.withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_cnt"))))
    gen = gen.withColumn("_nr", (F.pmod(F.xxhash64(q(key), F.col("_j"), F.lit(seed)), F.lit(k)) + 1).cast("int"))
    gen = gen.join(cut_lineage(nbr_vecs), ["_vk", "_nr"]).withColumn("_gap", _unit(q(key), F.col("_j"), F.lit(seed + 1)))
    if trace:
        gen = gen.withColumns({"smote_base": q(key).cast("string"), "smote_gap": F.col("_gap"), "smote_neighbour": F.col("_n")})
    new_feats = {c: q(c).cast("double") + F.col("_gap") * (F.col("_n")[i] - q(c).cast("double")) for i, c in enumerate(features)}
    synth = (gen.withColumns(new_feats)
             .withColumn(key, F.concat(q(key).cast("string"), F.lit("#s"), F.col("_j").cast("string")))
             .withColumn("synthetic", F.lit(1)))
    cols = base.columns
    return base.select(*[q(c) for c in cols]).unionByName(synth.select(*[q(c) for c in cols]))
