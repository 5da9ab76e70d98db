"""SimHash near-dedup with a Gray-order hierarchical index.

1. A fingerprint has bit i set if more than half of the text's shingle hashes
   have it (64 bits, repeats included).  Equal fingerprints become one class.
2. Fingerprints that differ in at most 3 bits agree on one of four 16-bit bands
   and, within the other 48 bits, on one of four 12-bit parts.  Each class goes to
   the 16 buckets so named (16 rows of two numbers); any link meets in one.
3. In a bucket, fingerprints sorted by Gray rank are the leaves of a tree.  A node
   holds the bits all its leaves share (mask and pattern); a child counts only the
   bits its parent has not.  A fingerprint descends, adding up differences, and
   leaves a whole group as soon as they exceed the bound.
4. A task returns a spanning forest of the links it found, not the links, so a
   dense group costs no more rows than it has members; alternating star joins
   then make the components.

No bucket is capped.  A task holds one bucket at a time (16 bytes a member) and
works through it in steps of bounded size.  A bucket of more than ``HOT`` members is
cut into blocks of its Gray order, and a task holds two blocks that may be linked.

Null and empty texts have fingerprint zero and are linked like any other.  Null
ids get no say in the smallest id of a component (null if it has only such).
Repeated rows get the same result each.  An empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import rank_within_groups
from ..session import cut_lineage
from .common import FEW_VALUES, keyed, without
from .components import connected_components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
BANDS, PARTS = 4, 4
SEGMENT = 1 << 20  # bytes of text taken at a time
FANOUT = 8
FRONTIER = 1 << 20  # pairs in flight
FLUSH = 1 << 20  # bucket members read before complete buckets are searched
HOT, BLOCK = 1 << 20, 1 << 17  # members from which on a bucket is cut, and of its blocks
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_bits(text: str, size: int = SHINGLE) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each of the 64 bits, and the number of shingles."""
    data = text.encode().lower()  # bytes: A-Z only
    counts, total, carry, at = np.zeros(64, dtype=np.int64), 0, [], 0
    digest = xxhash.xxh64_intdigest
    while at < len(data):
        end = at + SEGMENT
        if end < len(data):
            gap = _SPACE.search(data, end)
            end = gap.start() if gap else len(data)
        words = carry + data[at:end].split()
        at = end
        carry = words[-(size - 1):]
        n = len(words) - size + 1
        if n > 0:
            joined = b" ".join(words)
            ends = list(accumulate(len(w) + 1 for w in words))
            starts = [0, *ends]
            h = np.fromiter((digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[size - 1:])), np.uint64, n)
            counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
    if not total and carry:
        h = np.array([digest(b" ".join(carry), SEED)], dtype="<u8")
        return np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return counts, total


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Signed 64-bit value of the fingerprint."""
    counts, total = shingle_bits(text, size)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, fp."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint).astype("int64")

    return keyed(docs, id_col, text_col).select("doc_id", "text_key", of("text").alias("fp"))


def gray_rank(fp: Column) -> Column:
    """Place of ``fp`` in the binary-reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def bucket_keys(fp: Column) -> Column:
    """The 16 bucket numbers of a fingerprint: table, 16-bit band, 12-bit part of the rest."""
    bands = [F.shiftrightunsigned(fp, 16 * r).bitwiseAND(0xFFFF) for r in range(BANDS)]
    keys = []
    for r in range(BANDS):
        others = [b for i, b in enumerate(bands) if i != r]
        rest = others[0].bitwiseOR(F.shiftleft(others[1], 16)).bitwiseOR(F.shiftleft(others[2], 32))
        for s in range(PARTS):
            part = F.shiftrightunsigned(rest, 12 * s).bitwiseAND(0xFFF)
            keys.append(F.shiftleft(bands[r], 12).bitwiseOR(part).bitwiseOR(F.lit((r * PARTS + s) << 28)))
    return F.array(*keys)


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge components (labels are the least member) along the links a-b."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:  # point every member at the end of its chain
            short = labels[labels]
            if (short == labels).all():
                break
            labels = short


def _tree(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[dict], np.ndarray]:
    """Levels from roots to leaves over buckets [start, end) of Gray-sorted ``fp``, and each bucket's root."""
    levels = [{"all": fp, "any": fp, "first": np.arange(len(fp)), "last": np.arange(len(fp)) + 1, "child": None}]
    lo, hi = starts, ends  # node range of each bucket at the level
    while (hi - lo > 1).any():
        below = levels[-1]
        n = -(-(hi - lo) // FANOUT)
        offset = np.concatenate(([0], np.cumsum(n)))
        within = np.arange(offset[-1]) - np.repeat(offset[:-1], n)
        begin = np.repeat(lo, n) + within * FANOUT
        end = np.minimum(begin + FANOUT, np.repeat(hi, n))
        levels.append({"all": np.bitwise_and.reduceat(below["all"], begin), "any": np.bitwise_or.reduceat(below["any"], begin),
                       "first": below["first"][begin], "last": below["last"][end - 1], "child": (begin, end)})
        lo, hi = offset[:-1], offset[1:]
    for level in levels:
        level["mask"] = ~(level["all"] ^ level["any"])  # the bits that all leaves share
    return levels[::-1], lo


def bucket_links(keys: np.ndarray, fp: np.ndarray, nodes: np.ndarray, labels: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Merge ``labels`` over all pairs of one bucket within ``max_bits``.

    ``keys`` are sorted, ``fp`` is Gray-sorted within a key, ``nodes`` numbers the fingerprints.
    """
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    starts, ends = edge, np.concatenate((edge[1:], [len(keys)]))
    several = ends - starts > 1
    if not several.any():
        return labels
    keep = np.repeat(several, ends - starts)
    size = (ends - starts)[several]
    fp, nodes = fp[keep], nodes[keep]
    ends = np.cumsum(size)
    levels, root = _tree(fp, ends - size, ends)
    own_root = np.repeat(root, size)
    zero = np.uint64(0)
    step = FRONTIER // 64
    for at in range(0, len(fp), step):
        query = np.arange(at, min(at + step, len(fp)))
        work = [(0, query, own_root[query], np.zeros(len(query), dtype=np.uint8))]
        while work:
            depth, q, node, passed = work.pop()
            level = levels[depth]
            known = zero if depth == 0 else levels[depth - 1]["mask"][level["parent"][node]]
            differ = passed + np.bitwise_count((fp[q] ^ level["all"][node]) & level["mask"][node] & ~known)
            # a group goes when the differences exceed the bound or all its leaves are behind the query
            stay = (differ <= max_bits) & (level["last"][node] > q + 1)
            q, node, differ = q[stay], node[stay], differ[stay]
            if level["child"] is None:
                later = node > q
                labels = _join_labels(labels, nodes[q[later]], nodes[node[later]])
                continue
            begin, end = level["child"][0][node], level["child"][1][node]
            fan = end - begin
            below = levels[depth + 1]
            if "parent" not in below:
                below["parent"] = np.repeat(np.arange(len(level["child"][0])), level["child"][1] - level["child"][0])
            for lo in range(0, len(q), FRONTIER // FANOUT):
                part = slice(lo, lo + FRONTIER // FANOUT)
                count = fan[part]
                total = int(count.sum())
                first = np.repeat(begin[part] - (np.cumsum(count) - count), count) + np.arange(total)
                work.append((depth + 1, np.repeat(q[part], count), first, np.repeat(differ[part], count)))
    return labels


def _forest(keys: np.ndarray, fp: np.ndarray, max_bits: int) -> pa.RecordBatch:
    """(a, b): a spanning forest of the links within these complete buckets."""
    distinct, nodes = np.unique(fp, return_inverse=True)
    labels = bucket_links(keys, fp.view(np.uint64), nodes, np.arange(len(distinct)), max_bits)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return pa.RecordBatch.from_arrays([pa.array(distinct[linked]), pa.array(distinct[labels[linked]])], names=["a", "b"])


def _search(rows: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): a forest of the links within each bucket; ``rows`` has key, rank, fp."""
    rows = rows.repartition("key").sortWithinPartitions("key", "rank").select("key", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= FLUSH:
                keys, fp = (np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if cut:
                    yield _forest(keys[:cut], fp[:cut], max_bits)
                held, size = [(keys[cut:], fp[cut:])], len(keys) - cut
        if size:
            yield _forest(*(np.concatenate(c) for c in zip(*held)), max_bits)

    return rows.mapInArrow(search, "a long, b long")


def _hot_keys(classes: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Buckets of more than ``HOT`` fingerprints; none unless one of the 4 * 65536 bands is as large."""
    bands = F.array(*[F.shiftrightunsigned("fp", 16 * r).bitwiseAND(0xFFFF).bitwiseOR(F.lit(r << 16)) for r in range(BANDS)])
    full = classes.select(F.explode(bands).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    if not full.limit(1).count():
        return None
    hot = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"))
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= FEW_VALUES else hot


def _block_pairs(rows: DataFrame, max_bits: int) -> DataFrame:
    """The rows of hot buckets as one small bucket for each two blocks of one that may hold a link.

    A bucket is cut into blocks of the Gray order.  What all fingerprints of a block share is compared first: two blocks
    that differ in more shared bits than a link may are never brought together.
    """
    ranked = rank_within_groups(rows, "key", [F.col("rank")], "pos")
    placed = cut_lineage(ranked.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).drop("pos"))
    blocks = cut_lineage(placed.groupBy("key", "block").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")))
    shared = blocks.select("key", "block", "all", F.bitwise_not(F.col("all").bitwiseXOR(F.col("any"))).alias("mask"))
    other = shared.select(F.col("key").alias("key2"), F.col("block").alias("block2"), F.col("all").alias("all2"), F.col("mask").alias("mask2"))
    apart = F.bit_count(F.col("all").bitwiseXOR(F.col("all2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    pairs = cut_lineage(shared.join(other, (F.col("key") == F.col("key2")) & (F.col("block") <= F.col("block2")) & (apart <= max_bits))
                        .select("key", F.col("block").alias("i"), F.col("block2").alias("j")))
    either = pairs.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    # equal numbers of different pairs would only compare more
    return placed.join(either, ["key", "block"]).select(F.xxhash64("key", "i", "j").alias("key"), "rank", "fp")


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all within ``max_bits`` (3 at most)."""
    if max_bits > MAX_BITS:
        raise ValueError("the buckets guarantee links of up to 3 bits")
    rows = classes.select("fp", gray_rank(F.col("fp")).alias("rank"), F.explode(bucket_keys(F.col("fp"))).alias("key"))
    hot = _hot_keys(classes, rows)
    if hot is None:
        return _search(rows, max_bits)
    return _search(rows.join(hot, "key", "left_anti"), max_bits).unionByName(
        _search(_block_pairs(rows.join(hot, "key", "left_semi"), max_bits), max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: doc_id, text_key, fp, component_id (smallest id linked to it, itself included)."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(links(classes, max_bits))
    rooted = cut_lineage(classes.join(linked, classes["fp"] == linked["node"], "left")
                         .select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    least = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut_lineage(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with the smallest id of each component."""
    found = near_duplicates(docs, id_col, text_col, max_bits)
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), id_col, text_col)
