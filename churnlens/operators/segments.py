"""Stage 3: cancellation-reason segments of churned customers.

Text -> embedding -> k-means -> PCA over DataFrames.  The default embedder is
JVM-side (tokenise, hash words into buckets, L2 normalise), so no Python runs
per row; a model-backed embedder can be plugged in and runs in Arrow batches
on the executors, and so does clustering.

Clustering works on whole numbers.  Coordinates are fixed-point, so sums,
centres and distances are exact: labels hang on the rows and the seed, not on
partitions or the order of additions, and plain SQL gives the same.  Labels are
renumbered by size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from ..session import cut_lineage
from .cleaning import q
from .ranking import rank_within_groups, top_n_per_group

# Columns and sizes of the original segmentation.
TEXT_FEATURES = ["CORE_INDUSTRY", "PRACTICE_MANAGEMENT_SOFTWARE", "INTEGRATIONS", "STARTING_BUNDLE",
                 "LIFETIME_MONTHS"]
SUMMARY_COLUMNS = ["CORE_INDUSTRY", "LIFETIME_MONTHS", "PRACTICE_MANAGEMENT_SOFTWARE", "STARTING_BUNDLE",
                   "SWAT_CANCEL_SUMMARY"]
REASON_COLUMN = "SWAT_CANCEL_SUMMARY"
PROFILE_DIM, REASON_DIM = 12, 24
N_SEGMENTS, SEED = 3, 42
SEGMENT = "reason_segment"

Embedder = Callable[[list[str]], np.ndarray]


# --------------------------------------------------------------------------- text
def segment_input(df: DataFrame, reason: str = REASON_COLUMN, check_empty: bool = True) -> DataFrame:
    """Rows with a non-blank cancellation summary (stripped); raises on an empty result."""
    out = df.withColumn(reason, X.blank_to_null(q(reason))).filter(q(reason).isNotNull())
    if check_empty and out.isEmpty():
        raise ValueError("All rows are missing cancel summaries; nothing to cluster.")
    return out


def normalise_text(df: DataFrame, columns: Sequence[str] = TEXT_FEATURES) -> DataFrame:
    """Absent column -> 'Unknown'; stripped text with '', 'nan', 'None', null -> 'Unknown'."""
    return df.withColumns({c: (X.text_or_unknown(q(c)) if c in df.columns else F.lit(X.UNKNOWN))
                           for c in columns})


def profile_text(df: DataFrame, columns: Sequence[str] = TEXT_FEATURES) -> Column:
    """Space-joined normalised profile columns."""
    present = set(df.columns)
    parts = [X.text_or_unknown(q(c)) if c in present else F.lit(X.UNKNOWN) for c in columns]
    return F.concat_ws(" ", *parts)


# --------------------------------------------------------------------------- embeddings
def hashing_embedding(df: DataFrame, text: str, out: str, dim: int) -> DataFrame:
    """Lower-cased word tokens hashed into ``dim`` buckets by their md5, L2-normalised (JVM only)."""
    words = F.array_remove(F.split(F.lower(F.coalesce(q(text).cast("string"), F.lit(""))), r"[^0-9A-Za-z_]+"), "")
    bucket = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    counts = F.aggregate(F.transform(words, bucket), F.array_repeat(F.lit(0), dim),
                         lambda seen, b: F.transform(seen, lambda n, i: n + (i == b).cast("int")))
    norm = F.sqrt(F.aggregate("_counts", F.lit(0).cast("bigint"), lambda a, n: a + n.cast("bigint") * n).cast("double"))
    # generators, so that the lambdas below do not compute counts and norm again for every coordinate
    d = df.select("*", F.explode(F.array(counts)).alias("_counts"))
    d = d.select("*", F.explode(F.array(norm)).alias("_norm"))
    unit = F.transform("_counts", lambda n: F.when(F.col("_norm") > 0, n / F.col("_norm")).otherwise(0.0))
    return d.withColumn(out, array_to_vector(unit)).drop("_counts", "_norm")


def model_embedding(df: DataFrame, text: str, out: str, dim: int, embedder: Embedder,
                    key: str = "row_id") -> DataFrame:
    """Embed with a Python model in Arrow batches on the executors (``mapInPandas``).

    ``embedder`` maps a list of texts to an (n, dim) array.  Only the key and
    the text travel to Python; the vectors are joined back by key.
    """
    def run(batches):
        for b in batches:
            vecs = np.asarray(embedder(b[text].fillna("").astype(str).tolist()), dtype="float64")
            yield pd.DataFrame({key: b[key], out: list(vecs.reshape(len(b), dim))})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType),
                           T.StructField(out, T.ArrayType(T.DoubleType()))])
    emb = df.select(key, text).mapInPandas(run, schema)
    return df.join(emb.select(key, array_to_vector(out).alias(out)), key)


def embed(df: DataFrame, embedder: Embedder | None = None, profile_dim: int = PROFILE_DIM,
          reason_dim: int = REASON_DIM, reason: str = REASON_COLUMN, key: str = "row_id") -> DataFrame:
    """Profile embedding (``profile_dim``) next to reason embedding (``reason_dim``), concatenated."""
    d = df.withColumn("_profile_text", profile_text(df)).withColumn("_reason_text", q(reason).cast("string"))
    if embedder is None:
        d = hashing_embedding(d, "_profile_text", "profile_embedding", profile_dim)
        d = hashing_embedding(d, "_reason_text", "reason_embedding", reason_dim)
    else:
        d = model_embedding(d, "_profile_text", "profile_embedding", profile_dim, embedder, key)
        d = model_embedding(d, "_reason_text", "reason_embedding", reason_dim, embedder, key)
    asm = VectorAssembler(inputCols=["profile_embedding", "reason_embedding"], outputCol="embedding")
    return asm.transform(d).drop("_profile_text", "_reason_text")


# --------------------------------------------------------------------------- clustering
FIXED = 1 << 20  # fixed-point units in 1
MAX_ROUNDS = 100


def _fixed(features: str) -> Column:
    return F.transform(vector_to_array(F.col(features)), lambda v: F.floor(v * FIXED + 0.5))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _square_distances(x: np.ndarray, centres: Sequence[Sequence[int]]) -> np.ndarray:
    """Rows x centres, in whole numbers."""
    return np.stack([((x - np.array(c, dtype=np.int64)) ** 2).sum(axis=1) for c in centres], axis=1)


def seed_centres(rows: DataFrame, k: int, seed: int, key: str = "row_id", x: str = "_x") -> list[list[int]]:
    """Up to ``k`` rows, each drawn with a weight of its squared distance from those before (k-means++).

    Every row gets an exponential key: minus the logarithm of a hash in (0, 1],
    over its weight.  The row with the least key is a draw with just these
    weights, so a draw is one minimum over the rows in any order: a task sends
    its own least row.
    """
    centres: list[list[int]] = []
    for draw in range(k):
        digest = F.md5(F.concat_ws("|", q(key).cast("string"), F.lit(str(seed)), F.lit(str(draw))))
        unit = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + 1) / F.lit(float(1 << 48))

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = _matrix(batch.column(2))
                weight = _square_distances(at, centres).min(axis=1) if centres else np.ones(len(at), dtype=np.int64)
                with np.errstate(divide="ignore"):
                    e = np.where(weight > 0, -np.log(batch.column(1).to_numpy()) / weight, np.inf)
                for i in np.flatnonzero((e == e.min()) & (weight > 0)):
                    found = (float(e[i]), batch.column(0)[int(i)].as_py(), at[i].tolist())
                    best = found if best is None or found < best else best
            if best is not None:
                yield pa.record_batch([pa.array([v], t) for v, t in zip(best, (pa.float64(), pa.string(), pa.list_(pa.int64())))], names=["e", "id", "x"])

        # one row a task
        found = rows.select(q(key).cast("string").alias("id"), unit.alias("u"), F.col(x).alias("x")).mapInArrow(least, "e double, id string, x array<long>").collect()
        if not found:  # every row is a centre already
            break
        centres.append(list(min((r["e"], r["id"], r["x"]) for r in found)[2]))
    return centres


def _assign(rows: DataFrame, centres: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Number and sums of the rows nearest to each centre (the first of equals): a task sends a row a centre."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centres), dtype=np.int64), np.zeros((len(centres), len(centres[0])), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                own = _square_distances(x, centres).argmin(axis=1)
                n += np.bincount(own, minlength=len(centres))
                np.add.at(sums, own, x)
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["k", "n", "sums"])

    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows.select("_x").mapInArrow(part, "k int, n long, sums array<long>").collect():
        n, sums = found.get(r["k"], (0, [0] * len(r["sums"])))
        found[r["k"]] = (n + r["n"], [a + b for a, b in zip(sums, r["sums"])])
    return dict(sorted(found.items()))


def cluster(df: DataFrame, k: int = N_SEGMENTS, seed: int = SEED, features: str = "embedding",
            out: str = SEGMENT, key: str = "row_id") -> tuple[DataFrame, list[list[float]]]:
    """k-means with k clamped to the number of distinct rows; labels 1..k ordered by segment size
    (largest first, ties by centre).  Returns rows with labels and the centres in label order.

    A round assigns rows to the nearest centre and moves every centre to the mean
    of its rows, rounded down to fixed point, until no centre moves.  A centre
    without rows goes.  Rounds read a narrow written table of fixed-point vectors.
    """
    if k < 1:
        raise ValueError("n_clusters must be >= 1")
    rows = cut_lineage(df.select(q(key), _fixed(features).alias("_x")))
    centres = seed_centres(rows, k, seed, key)
    if not centres:
        raise ValueError("No embeddings available for clustering.")
    found = _assign(rows, centres)
    for _ in range(MAX_ROUNDS):
        moved = [[s // n for s in sums] for n, sums in found.values()]
        if moved == centres:
            break
        centres = moved
        found = _assign(rows, centres)
    kept = [i for i in range(len(centres)) if i in found]  # a centre may have lost its last row in the last round
    centres, sizes = [centres[i] for i in kept], [found[i][0] for i in kept]
    order = sorted(range(len(centres)), key=lambda i: (-sizes[i], centres[i]))
    place = np.argsort(order) + 1

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = place[_square_distances(_matrix(batch.column(1)), centres).argmin(axis=1)] if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(own.astype(np.int32))], names=["_key", out])

    labels = rows.mapInArrow(label, T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField(out, T.IntegerType())]))
    return df.join(labels, q(key).eqNullSafe(F.col("_key"))).drop("_key"), [[c / FIXED for c in centres[i]] for i in order]


def nearest_centre_violations(df: DataFrame, centres: list[list[float]], features: str = "embedding",
                              label: str = SEGMENT) -> Column:
    """Count of rows whose assigned centre is farther than another centre (by more than fixed point tells apart)."""
    x = vector_to_array(F.col(features))

    def sqdist(c: list[float]) -> Column:
        return F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda acc, v: acc + v)
    dists = [sqdist(c) for c in centres]
    best = F.least(*dists) if len(dists) > 1 else dists[0]
    own = F.element_at(F.array(*dists), F.col(label).cast("int"))
    return F.count_if(own > best + F.lit(1e-4))


def pca_2d(df: DataFrame, features: str = "embedding", k: int = 2) -> DataFrame:
    """Centre the vectors, then project on the top-``k`` principal components.

    MLlib's PCA projects uncentred data, so centring is an explicit
    StandardScaler(withMean=True, withStd=False) step.  Fewer than 2 rows have
    no direction of variance: their components are null.
    """
    if df.limit(2).count() < 2:
        return df.select("*", *[F.lit(None).cast("double").alias(f"pc{i + 1}") for i in range(k)])
    centred = StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False)
    c = centred.fit(df).transform(df)
    p = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(c).transform(c)
    arr = vector_to_array(F.col("_pc"))
    return p.select("*", *[arr[i].alias(f"pc{i + 1}") for i in range(k)]).drop("_centred", "_pc")


def augment_with_segment(full: DataFrame, labelled: DataFrame, key: str = "row_id",
                         label: str = SEGMENT) -> DataFrame:
    """All input rows with the segment label where one was assigned (null otherwise)."""
    return full.join(labelled.select(key, label), key, "left")


# --------------------------------------------------------------------------- segment text tables
def markdown_lines(df: DataFrame, group: str, columns: Sequence[str] = SUMMARY_COLUMNS,
                   order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Markdown table of every group's rows, one output row per table line.

    (group, line_no, line): line 0 is the header, 1 the separator, then one
    line per input row in ``order`` (which must be unique); a null cell is
    blank and the null group has a table too.  Rows are never concatenated into
    one value.  Line numbers come from a range-partitioned rank of (group,
    order) rows, so a group of any size stays spread over many tasks and whole
    lines are only joined to their numbers; writing the lines ordered by
    (group, line_no) yields each table's text.
    """
    header = "| " + " | ".join(columns) + " |"
    sep = "| " + " | ".join("-" * len(c) for c in columns) + " |"
    cells = [F.coalesce(q(c).cast("string"), F.lit("")) for c in columns]
    body_line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = df.select(q(group).alias("grp"), *[q(o) for o in order], body_line.alias("line"))
    ranked = rank_within_groups(rows.drop("line"), "grp", [F.col(f"`{o}`") for o in order], "pos")
    place = ranked.select((F.col("pos") + 1).alias("line_no"), *[F.col(f"`{o}`").alias(f"_o{i}") for i, o in enumerate(order)])
    same = [F.col(f"`{o}`").eqNullSafe(F.col(f"_o{i}")) for i, o in enumerate(order)]
    body = rows.join(place, same).select("grp", "line_no", "line")
    heads = rows.select("grp").distinct()
    top = heads.select("grp", F.lit(0).cast("long").alias("line_no"), F.lit(header).alias("line")).unionByName(
        heads.select("grp", F.lit(1).cast("long").alias("line_no"), F.lit(sep).alias("line")))
    return top.unionByName(body).withColumnRenamed("grp", group)


def segment_examples(df: DataFrame, group: str, n: int = 3, chars: int = 200,
                     order: Sequence[str] = ("row_id",)) -> DataFrame:
    """First ``n`` rows of each group with the report fields and the first ``chars`` of the reason."""
    ex = top_n_per_group(df, [group], [q(o) for o in order], n, salt_key=q(order[0]), rank_col="example")
    return ex.select(q(group), "example", q("LOCATION_NAME"), q("CORE_INDUSTRY"), q("STARTING_BUNDLE"),
                     q("STARTING_MRR"), q("LIFETIME_MONTHS"), q("PRACTICE_MANAGEMENT_SOFTWARE"),
                     F.substring(q(REASON_COLUMN), 1, chars).alias("reason_excerpt"))
