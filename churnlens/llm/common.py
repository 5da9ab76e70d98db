"""Column helpers shared by the corpus operators.

Every operator starts from ``keyed``: the id, the text (null: empty) and a hash
of the text, under names of its own, so that extra input columns cannot clash.
The pair (id, text hash) keys a row: rows that share an id but not a text stay
apart, rows repeated in full are one document and get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# fixed values: characters between words (after lower-casing), and alphabets
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

FEW_VALUES = 100_000  # rows of a value and a number that may be broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  On pure ASCII text that is ``lower``, which is much cheaper than ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text), WORD_GAP), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def chars_in(text: Column, chars: str) -> Column:
    """How many characters of a text are in the regex class ``chars``."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{chars}+", ""))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, text) with null text as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def left_join_on_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the row key (null ids equal each other); the key columns appear once."""
    other = right.withColumnRenamed("doc_id", "__doc_id").withColumnRenamed("text_key", "__text_key")
    on = left["doc_id"].eqNullSafe(other["__doc_id"]) & (left["text_key"] == other["__text_key"])
    return left.join(other, on, "left").drop("__doc_id", "__text_key")


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose key is in ``dropped`` (doc_id, text_key)."""
    gone = dropped.select(F.col("doc_id").alias("__gone_id"), F.col("text_key").alias("__gone_key"))
    key = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone_id"]) & (key == gone["__gone_key"]), "left_anti")


def as_struct_rows(spark: SparkSession, rows: list[Column]) -> DataFrame:
    """A small fixed table from struct literals, built on the JVM."""
    return spark.range(1).select(F.inline(F.array(*rows)))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's text, modulo ``folds``; null ids are in no fold (null)."""
    return F.crc32(doc_id.cast("string")) % folds


def bounded_share(rows: DataFrame, key: Column, most: int, by: str | None = None) -> DataFrame:
    """About ``most`` rows (of each value of ``by`` but null), chosen by a hash of ``key``.

    One count gives the share to keep, so no rows are sorted or gathered; all
    rows stay where there are no more.  Rows with one key stay or go together:
    ``bounded_rows`` bounds what they amount to.
    """
    place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / float(1 << 30)
    if by is None:
        n = rows.count()
        return rows if n <= most else rows.where(place < most / n)
    share = cut_lineage(rows.groupBy(F.col(by).alias("__by")).agg(F.least(F.lit(1.0), most / F.count(F.lit(1))).alias("__share")))
    if share.count() <= FEW_VALUES:  # beyond that the join is left to Spark
        share = F.broadcast(share)
    return rows.join(share, rows[by] == share["__by"]).where(place < F.col("__share")).drop("__by", "__share")


def bounded_rows(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct (doc_id, text_key) of ``rows``, the first by a hash of both, with their other columns.

    Rows repeated in full count once, so an id or a text that holds any share of the rows keeps the bound.  The keys are
    chosen by themselves; other columns, whole texts say, only move for the rows that were chosen.
    """
    keys = rows.select(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key")).distinct()
    keys = keys.orderBy(F.xxhash64(F.lit("rows"), "__doc_id", "__text_key"), "__doc_id", "__text_key").limit(most)
    on = rows["doc_id"].eqNullSafe(F.col("__doc_id")) & (rows["text_key"] == F.col("__text_key"))
    # the broadcast side holds at most ``most`` pairs of numbers
    return rows.join(F.broadcast(keys), on, "left_semi").dropDuplicates(["doc_id", "text_key"])
