"""Source divergence audit: how far apart the sources of each language are, by cube partitioning.

Rows are (language, source) groups, columns are the terms of the language.  The
pairwise work is a cube cut into cells (group block, group block, term block): a
cell gets the slices of both group blocks on its term block, sums |p - q| there
for every pair of its groups, and the sums are added along the term axis.
1. Terms are counted by (language, source, term), documents by (language, term),
   in one scan, combined before the shuffle; terms in ``min_docs`` documents stay.
2. p = 1 + floor(scale * (count + smooth) / (N + smooth * V)) in whole numbers, so
   every sum is exact and does not hang on the order of the rows.
3. A slice holds counted terms only.  Terms that no group of a cell has cost
   nothing: each adds the difference of the two groups' p at count 0, so their
   number is enough.

Blocks are dealt by hash; a cell holds about 2 * ``GROUP_BLOCK`` * ``TERM_BLOCK``
numbers, whatever the number of sources and terms.

Null text, lang and source are ''.  Repeated rows are documents of their own.
Groups without terms take part (all their counts are 0); a language without kept
terms has value 0 for every pair and no ``term`` rows.  Ties rank by item in
UTF-8 order.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ascii_lower

# fixed values: characters between terms (everything in ASCII but letters)
TERM_GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
GROUP_BLOCK, TERM_BLOCK = 32, 1024


def _terms_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), TERM_GAP), "")


def _share(count: str, total: str, terms: str, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * terms)), exact beyond 64 bits; null without terms."""
    return F.expr(f"1 + ({scale} * CAST({count} + {smooth} AS DECIMAL(19, 0))) DIV "
                  f"CAST(nullif({total} + {smooth} * {terms}, 0) AS DECIMAL(20, 0))")


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in a group, and the group's documents that have it.

    Every group has one more row, of the null term, with its number of documents.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), _terms_of(plain(text_col)).alias("terms"))
    # (term, occurrence) for every place, (term, document) once a document, (null, document) for the group itself
    parts = F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("docs"), F.col("terms").alias("terms")),
                    F.struct(F.lit(0).alias("n"), F.lit(1).alias("docs"), F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string"))).alias("terms")))
    places = (rows.select("lang", "source", F.explode(parts).alias("part"))
              .select("lang", "source", F.col("part.n").alias("n"), F.col("part.docs").alias("docs"), F.explode("part.terms").alias("term")))
    return places.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _cell_sums(table: pa.Table) -> pa.Table:
    """Partial divergences of one cell: (lang, a, b, part, seen, none_a, none_b) for every pair of its groups."""
    side, term = table["side"].to_numpy(), table["term"].combine_chunks()
    name, p = np.array(table["source"].to_pylist(), dtype=object), table["p"].to_numpy()
    head = np.array(term.is_null())  # one row for every group of the cell, with its p at count 0
    at = term.filter(pa.array(~head)).dictionary_encode()
    place, seen = np.asarray(at.indices), len(at.dictionary)
    slices = []
    for s in (0, 1):
        groups = sorted(set(name[head & (side == s)]))
        order = {g: i for i, g in enumerate(groups)}
        none = np.zeros(len(groups), dtype=np.int64)
        none[[order[g] for g in name[head & (side == s)]]] = p[head & (side == s)]
        own = ~head & (side == s)
        full = np.repeat(none[:, None], seen, axis=1)
        full[[order[g] for g in name[own]], place[own[~head]]] = p[own]
        slices.append((groups, none, full))
    (left, none_a, a), (right, none_b, b) = slices
    same = table["i"][0] == table["j"][0]  # a cell on the diagonal has one side only
    out = []
    for i in range(len(left)):
        others = range(i + 1, len(left)) if same else range(len(right))
        rows = (a if same else b)[others.start:others.stop]
        out += [(left[i], (left if same else right)[j], int(v), int(none_a[i]), int((none_a if same else none_b)[j]))
                for j, v in zip(others, np.abs(rows - a[i]).sum(axis=1), strict=True)]
    cols = list(zip(*out, strict=True)) or [[]] * 5
    lang = table["lang"][0].as_py()
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    a_name, b_name, part, at_a, at_b = (pa.array(c, t) for c, t in zip(cols, types, strict=True))
    n = len(out)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "a": a_name, "b": b_name, "part": part,
                     "seen": pa.array([seen] * n, pa.int64()), "none_a": at_a, "none_b": at_b})


def pair_divergences(groups: DataFrame, slices: DataFrame, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, a, b, value) for every pair of groups of a language, a and b in either order once.

    ``groups``: lang, source, terms (V of the language), none (p at count 0);
    ``slices``: lang, source, term, p of the counted terms.
    """
    size = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / group_block).cast("int").alias("blocks"),
                                      F.greatest(F.ceil(F.first("terms") / term_block), F.lit(1)).cast("int").alias("cuts"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    heads = (groups.join(size, "lang")
             .select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"), "blocks", block.alias("block"),
                     F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")))
    rows = (slices.join(size, "lang")
            .select("lang", "source", "term", "p", "blocks", block.alias("block"), F.pmod(F.xxhash64("term"), F.col("cuts")).cast("int").alias("cut")))
    # a slice goes to every cell of its row and column of the cube
    cells = heads.unionByName(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cut",
                         (F.col("block") > F.col("other")).cast("int").alias("side"), "source", "term", "p")
    parts = cells.groupBy("lang", "i", "j", "cut").applyInArrow(
        _cell_sums, "lang string, a string, b string, part long, seen long, none_a long, none_b long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"),
                                               F.first("none_a").alias("none_a"), F.first("none_b").alias("none_b"))
    terms = groups.groupBy("lang").agg(F.first("terms").alias("terms"))
    return sums.join(terms, "lang").select(
        "lang", "a", "b", (F.col("part") + (F.col("terms") - F.col("seen")) * F.abs(F.col("none_a") - F.col("none_b"))).alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, smooth: int = SMOOTH, scale: int = SCALE, top_terms: int = TOP_TERMS,
                  group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module's text."""
    counted = cut_lineage(count_terms(docs))
    kept = cut_lineage(counted.where("term IS NOT NULL").groupBy("lang", "term")
                       .agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n")).where(F.col("in_docs") >= min_docs)
                       .select("lang", "term", "lang_n"))
    inside = cut_lineage(counted.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = inside.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    groups = cut_lineage(
        counted.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .select("lang", "source", zero("terms"), zero("lang_total"), zero("total"))
        .withColumn("none", F.coalesce(_share("0", "total", "terms", smooth, scale), F.lit(0))))
    shares = cut_lineage(
        inside.join(groups, ["lang", "source"])
        .select("lang", "source", "term", _share("n", "total", "terms", smooth, scale).alias("p"),
                _share("lang_n", "lang_total", "terms", smooth, scale).alias("q")))

    pairs = pair_divergences(groups, shares.select("lang", "source", "term", "p"), group_block, term_block)
    both = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                           F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("side"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = both.select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value").withColumn("rank", F.row_number().over(order))
    by_term = (shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
               .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms))
    return by_pair.unionByName(by_term)
