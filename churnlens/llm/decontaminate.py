"""Benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of an item (a shorter item is one window).
Windows are sets of positioned shingles.  Shingles are ordered by how often the
corpus holds them; since a window must be contained in full, its rarest shingle
is a sufficient prefix, and a window with a shingle the corpus never holds is
dropped.  Document shingles join the prefix, the shingle's place gives the only
possible start, length bounds apply, and the words are then compared in full.

Null texts have no words; items without words have no window.  A null item id
hits words but is neither counted nor listed.  Repeated rows get the same result
each.  Empty tables give zeros or an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import keyed, left_join_on_key, without, word_count, words_of

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 200_000  # index rows of about 100 bytes


def _shingle_key(words: Column, at: Column, k: int) -> Column:
    """Hash of ``k`` words from place ``at`` (0-based)."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def _starts(n: Column, k: int) -> Column:
    """0 .. n-k, or null; an expression, so that no size filter re-evaluates the words."""
    return F.when(n >= k, F.sequence(F.lit(0), n - k))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item_id, win, n): the distinct windows of each item, words joined by one space."""
    words = items.select(F.col(id_col).alias("item_id"),
                         words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    n = F.size("w")
    start = F.explode(F.when(n > size, F.sequence(F.lit(1), n - size + 1)).when(n > 0, F.array(F.lit(1))))
    win = words.select("item_id", "w", start.alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("v"))
    return win.select("item_id", F.concat_ws(" ", "v").alias("win"), F.size("v").alias("n")).distinct()


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(win, n, k, key, at): the shingles of each distinct window; k is less for windows under ``shingle`` words."""
    wins = windows.select("win", "n").distinct().withColumn("v", F.split("win", " "))
    parts = []
    for k in range(1, shingle + 1):
        of_k = wins.where(F.col("n") >= shingle if k == shingle else F.col("n") == k)
        parts.append(of_k.select("win", "n", "v", F.explode(_starts(F.col("n"), k)).alias("at"))
                     .select("win", "n", F.lit(k).alias("k"), _shingle_key(F.col("v"), F.col("at"), k).alias("key"), "at"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def doc_shingles(rows: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, words, at, key): every shingle of every document."""
    words = rows.select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    return (words.select("doc_id", "text_key", "words", F.explode(_starts(F.size("words"), k)).alias("at"))
            .withColumn("key", _shingle_key(F.col("words"), F.col("at"), k)))


def _starts_in(words: Column, start: Column, n: Column, win: Column) -> Column:
    """Whether the window's words stand at ``start``: bounds first, then word for word."""
    inside = (start >= 0) & (start + n <= F.size(words))
    return inside & (F.concat_ws(" ", F.slice(words, F.greatest(start, F.lit(0)) + 1, n)) == win)


def find_windows(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, start, n, win): every occurrence of every window.

    An index of at most ``broadcast_rows`` shingles goes to every task, and words
    are compared where they are.  A larger one is joined by shuffles of narrow
    rows (id, place, shingle hash), and candidates go back to their documents.
    """
    rows = keyed(docs, id_col, text_col)
    index = cut_lineage(window_shingles(windows))
    sizes = {r["k"]: r["count"] for r in index.groupBy("k").count().collect()}  # at most SHINGLE rows
    found = None
    for k, size in sorted(sizes.items()):
        small = size <= broadcast_rows
        placed = doc_shingles(rows, k)
        own = index.where(F.col("k") == k)
        if small:
            counts = placed.join(F.broadcast(own.select("key").distinct()), "key").groupBy("key").agg(F.count(F.lit(1)).alias("held"))
        else:
            counts = placed.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
        # rarest shingle of each window; windows with an absent one are gone
        ranked = own.join(counts, "key", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        prefix = cut_lineage(ranked.groupBy("win", "n").agg(F.min(F.struct("held", "key", "at")).alias("p"))
                             .where("p.held > 0").select("win", "n", F.col("p.key").alias("key"), F.col("p.at").alias("offset")))
        start = (F.col("at") - F.col("offset")).alias("start")
        here = ("doc_id", "text_key", "start", "n", "win")
        if small:
            hit = placed.join(F.broadcast(prefix), "key").select("doc_id", "text_key", "words", start, "n", "win")
        else:
            near = placed.select("doc_id", "text_key", "at", "key").join(prefix, "key").select("doc_id", "text_key", start, "n", "win")
            # candidates of a document are fewer than its words times the windows of one shingle
            per_doc = near.where("start >= 0").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n", "win")).alias("near"))
            hit = (left_join_on_key(rows, per_doc).where("near IS NOT NULL")
                   .select("doc_id", "text_key", words_of(F.col("text")).alias("words"), F.explode("near").alias("c"))
                   .select("doc_id", "text_key", "words", "c.*"))
        hit = hit.where(_starts_in(F.col("words"), F.col("start"), F.col("n"), F.col("win"))).select(*here)
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = rows.select("doc_id", "text_key", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("win")).limit(0)
    return cut_lineage(found.distinct())


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, n_items, items (sorted strings), contaminated."""
    windows = cut_lineage(item_windows(items))
    found = find_windows(docs, windows, id_col, text_col)
    in_order = Window.partitionBy("doc_id", "text_key").orderBy("start")
    end = F.col("start") + F.col("n")
    spans = (found.groupBy("doc_id", "text_key", "start").agg(F.max("n").alias("n"))
             .withColumn("before", F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))))
    hits = (spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("before", F.lit(0)))))
            .groupBy("doc_id", "text_key").agg(F.sum("new").alias("n_hit")))
    listed = (found.select("doc_id", "text_key", "win").distinct()
              .join(windows.select("item_id", "win"), "win").where(F.col("item_id").isNotNull())
              .groupBy("doc_id", "text_key").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")))
    rows = keyed(docs, id_col, text_col).select("doc_id", "text_key", word_count(F.col("text")).alias("n_words"))
    out = left_join_on_key(left_join_on_key(rows, hits), listed)
    items_col = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(items_col).cast("long").alias("n_items"), items_col.alias("items"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    windows = cut_lineage(item_windows(items))
    found = find_windows(docs, windows, id_col, text_col)
    return without(docs, found.select("doc_id", "text_key").distinct(), id_col, text_col)
