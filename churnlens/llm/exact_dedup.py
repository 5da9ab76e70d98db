"""Exact dedup by content-defined chunk recipes.

A text is cut where its own bytes say so, in any script: chunks end where the last
bytes of three characters in a row fall into a quarter of all values, so equal
passages are cut alike soon after a difference.
1. Every distinct chunk travels once (combined in each map task before the
   shuffle) to prove byte for byte which contents an identifier names.  Where it
   names several, they get ordinals, which become part of the identifier.
2. A document is then its ordered list of identifiers, its recipe; documents are
   grouped and compared by recipe, and long texts do not move again.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Of equal texts the row with the largest id stays (a null id only if all are
null).  Rows repeated in full share an id and so share the verdict.  An empty
table gives an empty result; input columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ascii_lower, keyed, left_join_on_key, without

# fixed values, over hex digits: a chunk ends after three characters whose last bytes have these lower halves, and before a character
CUT_AFTER, CUT_BEFORE = "(?:(?:[0-7]|[C-F].(?:[89AB].){0,2}[89AB])[05AF]){3}", r"(?=[0-7C-F]|\z)"
MIN_BYTES, MAX_BYTES = 1024, 4096


def hex_of(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def chunks_of(hexed: Column, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES) -> Column:
    """Content-defined chunks of the hex digits of a text; their concatenation is the input (an empty text has none)."""
    return F.regexp_extract_all(
        hexed, F.lit(rf"(?:..){{{min_bytes},{max_bytes - 12}}}?{CUT_AFTER}{CUT_BEFORE}|(?:..){{1,{max_bytes}}}{CUT_BEFORE}"), F.lit(0))


def chunk_id(chunk: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(chunk, 256), 1, 32))


def _contents(rows: DataFrame) -> DataFrame:
    """Distinct (id, chunk); ``rows`` has the normalised ``text``."""
    chunk = rows.select(F.explode(chunks_of(hex_of(F.col("text")))).alias("chunk"))
    return chunk.select(chunk_id(F.col("chunk")).alias("id"), "chunk").distinct()


def ambiguous_ids(rows: DataFrame) -> DataFrame:
    """Identifiers that name more than one content; ``rows`` has the normalised ``text``."""
    return _contents(rows).groupBy("id").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")


def _resolved(rows: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(doc_id, text_key, recipe) of every distinct row, with an ordinal behind each ambiguous identifier."""
    order = Window.partitionBy("id").orderBy("chunk")  # the contents of one identifier
    ordinals = _contents(rows).join(ambiguous, "id", "left_semi").withColumn("ordinal", F.row_number().over(order))
    places = (rows.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.posexplode_outer(chunks_of(hex_of(F.col("text")))).alias("pos", "chunk"))
              .withColumn("id", chunk_id(F.col("chunk"))))
    named = places.join(ordinals, ["id", "chunk"], "left").select(
        "doc_id", "text_key", "pos", F.when(F.col("ordinal").isNull(), F.col("id")).otherwise(F.concat("id", F.encode(F.col("ordinal").cast("string"), "UTF-8"))).alias("id"))
    listed = named.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("parts"))
    return listed.select("doc_id", "text_key", F.filter(F.col("parts.id"), lambda i: i.isNotNull()).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, keep_id, group_size, kept, text_sha256."""
    rows = keyed(docs, id_col, text_col).withColumn("text", ascii_lower(F.col("text")))
    ambiguous = cut_lineage(ambiguous_ids(rows).select("id"))
    recipes = rows.select("doc_id", "text_key", F.transform(chunks_of(hex_of(F.col("text"))), chunk_id).alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
    if ambiguous.limit(1).count():
        recipes = left_join_on_key(recipes.drop("recipe"), _resolved(rows, ambiguous))
    recipes = cut_lineage(recipes)
    # Both join sides are read from tables, so each has a shuffle of its own and a
    # hot recipe can be split between tasks.
    groups = cut_lineage(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"),
                                                       F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    return (recipes.join(groups, "recipe", "left")
            .select("doc_id", "text_key",
                    F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one id kept of each set of equal texts."""
    return without(docs, exact_dedup(docs, id_col, text_col).where(~F.col("kept")), id_col, text_col)
