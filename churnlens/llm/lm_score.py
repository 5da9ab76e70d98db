"""LM scoring with a log-frequency Bloom filter.

Model.  n-grams (one and two tokens) are counted once over all training texts under
hashes: a block number and 32 bits within the block.  An n-gram of count c enters the filter with its levels
0 .. floor(log2 c); a lookup probes level 0, 1, ... until a probe misses, and the
levels that were there give the quantised count.  Bigram estimates are interpolated
with add-half unigram estimates.

The filter is a table of packed blocks.  An n-gram's block follows from its hash;
the number of blocks grows with the training tokens, and a block has
``BITS_PER_LEVEL`` bits for each level of each of its n-grams: whatever the input's
size, no n-gram is left out and the rate of false levels stays the same.
Scoring takes one of two ways to the same bits, by the filter's size:
* up to ``FILTER_BYTES`` the packed filter is broadcast, and a task probes it for
  the n-grams of its texts;
* beyond, chunks of about ``SCORE_CHUNK`` tokens send the hashes of their distinct
  n-grams to the blocks in a shuffle, the blocks are probed where they are, and the
  levels come back to the chunk.  No task holds more than a bundle or a chunk.
Neighbouring blocks travel as one bundle: a chunk sends and gets a row for each
bundle, and a bundle's blocks are probed for the n-grams of many chunks at once.
With a row for each block, rows and probes would be chunks times blocks, which
grows with the square of the input.

Base.  The add-half unigram score uses exact counts: the ``HEAD`` most frequent
tokens at most (and at most ``HEAD_BYTES`` of them) go to every task, the others
meet their counts in a join.

A text's tokens are its runs of characters other than white space, A-Z in lower
case, and one end token.  Null texts are empty and have the end token only.  Rows
with a null id are neither held out nor learned from.  Repeated rows get the same
result each.  With nothing to learn from, every token has the probability that
add-half gives with no counts.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fold, keyed

END = b"\n"  # no word has white space
KEY_BITS, LOW_BITS = 56, 32
BLOCK_TOKENS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 18, 1 << 6, 1 << 24
BUNDLES, BUNDLE_BLOCKS = 1 << 9, 1 << 6  # more blocks than BUNDLES travel in bundles of up to BUNDLE_BLOCKS
FILTER_BYTES = 1 << 26
PROBES = 3
BITS_PER_LEVEL = 8
LEVELS = 40
HEAD, HEAD_BYTES = 1 << 20, 1 << 25
VOCABULARY = 1 << 18  # tokens a task counts between outputs
FACTS = 1 << 16  # tokens a task knows the facts of between chunks
COUNT_CHUNK = 1 << 20  # tokens counted at a time
SCORE_CHUNK = 1 << 19  # tokens of a chunk that travels
HERE_CHUNK = 1 << 16  # tokens of a chunk that is scored where it is read
ASKED = 1 << 18  # n-grams a bundle is probed for at a time
BIGRAM_SHARE = 0.7

_U = np.uint64


def tokens_of(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    words.append(END)
    return words


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unigram_keys(h: np.ndarray) -> np.ndarray:
    return _mix(h + _U(0x9E3779B97F4A7C15)) >> _U(64 - KEY_BITS)


def bigram_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _mix(before * _U(0xD6E8FEB86659FD93) + h) >> _U(64 - KEY_BITS)


class Vocabulary(dict):
    """Token -> number; numbers are dealt in order of first sight."""

    def __missing__(self, token: bytes) -> int:
        self[token] = number = len(self)
        return number


def _numbered(texts: Iterable[str], vocabulary: Vocabulary, chunk: int) -> Iterator[list[np.ndarray]]:
    """Lists of documents' token numbers, about ``chunk`` tokens at a time (a document is never split)."""
    held, size = [], 0
    for text in texts:
        words = tokens_of(text)
        held.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        size += len(words)
        if size >= chunk:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in _let_go(batches):
        yield from (t.as_py() for t in batch.column(0))


def _let_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory that Arrow keeps of earlier ones goes back, as workers live on after their tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def count_tokens(training: DataFrame) -> DataFrame:
    """(token, n): exact counts, combined in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
        for text in _texts(batches):
            counts.update(tokens_of(text))
            if len(counts) >= VOCABULARY:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return training.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def block_number(tokens: int) -> int:
    """How many blocks (a power of two) the n-grams of so many training tokens are dealt into."""
    return min(max(1 << max(0, int(tokens) // BLOCK_TOKENS).bit_length(), LEAST_BLOCKS), MOST_BLOCKS)


def split_keys(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block numbers and the bits within the block, of the same order as the keys."""
    wide = blocks.bit_length() - 1
    return (keys >> _U(KEY_BITS - wide)).astype(np.int64), (keys >> _U(KEY_BITS - wide - LOW_BITS)) & _U((1 << LOW_BITS) - 1)


def bundle_width(blocks: int) -> int:
    """How many neighbouring blocks travel together (a power of two)."""
    return min(max(blocks // BUNDLES, 1), BUNDLE_BLOCKS)


def _by_block(keys: np.ndarray, blocks: int, width: int = 1) -> tuple[np.ndarray, list[tuple[int, int]], list[bytes]]:
    """Sorted keys as numbers of bundles of ``width`` blocks, their places among the keys, and the packed keys: how many each
    block but the last has, then the bits within the blocks."""
    block, low = split_keys(keys, blocks)
    bundle = block // width
    edges = np.flatnonzero(np.concatenate(([True], bundle[1:] != bundle[:-1], [True])))
    index = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    sizes = np.bincount(index * width + block % width, minlength=(len(edges) - 1) * width).reshape(-1, width)[:, :-1].astype("<u4")
    low, places = low.astype("<u4"), list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return bundle[edges[:-1]].astype(np.int32), places, [n.tobytes() + low[a:b].tobytes() for n, (a, b) in zip(sizes, places)]


def _ends(data: bytes, width: int) -> np.ndarray:
    """Where, among a bundle's packed keys, each block's begin and the last one's end."""
    sizes = np.frombuffer(data, dtype="<u4", count=width - 1).astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes), [len(data) // 4 - len(sizes)]))


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4").astype(np.uint64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in lists of equal first column (neighbours)."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _places(low: np.ndarray, level: int, bits: np.ndarray | int) -> list[np.ndarray]:
    """The bits of a level within a block of ``bits`` bits (fewer than 2^32)."""
    x = _mix(low * _U(0x9E3779B97F4A7C15) + _U((level + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
    first, step, half = x >> _U(32), (x & _U(0xFFFFFFFF)) | _U(1), _U(0xFFFFFFFF)
    size = np.asarray(bits).astype(np.uint64)
    return [((((first + _U(i) * step) & half) * size) >> _U(32)).astype(np.int64) for i in range(PROBES)]


def _levels_of(n: np.ndarray) -> np.ndarray:
    """The number of levels of each count: 1 + floor(log2 count)."""
    return np.minimum(np.log2(n).astype(np.int64), LEVELS - 1) + 1


def filled_block(low: np.ndarray, n: np.ndarray) -> bytes:
    """The packed bits of a block that holds distinct keys with counts ``n``."""
    top = _levels_of(n)
    size = -(-int(top.sum()) * BITS_PER_LEVEL // 64) * 64
    bits = np.zeros(size, dtype=bool)
    for level in range(int(top.max(initial=0))):
        for place in _places(low[top > level], level, size):
            bits[place] = True
    return np.packbits(bits, bitorder="little").tobytes()


def build_blocks(training: DataFrame, blocks: int) -> DataFrame:
    """The filter: (block, bits) of every block that has n-grams."""
    width = bundle_width(blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for docs in _numbered(_texts(batches), vocabulary, COUNT_CHUNK):
            h = _hashes(vocabulary)
            found = []
            for number in docs:
                token = h[number]
                found.append(bigram_keys(np.concatenate(([_U(0)], token[:-1])), token))
            single, n1 = np.unique(np.concatenate(docs), return_counts=True)
            double, n2 = np.unique(np.concatenate(found), return_counts=True)
            keys, n = np.concatenate((unigram_keys(h[single]), double)), np.concatenate((n1, n2))
            order = np.argsort(keys, kind="stable")
            bundle, places, low = _by_block(keys[order], blocks, width)
            size = n[order].astype("<u4")
            counts = [(size[a:b].astype(np.uint8) if size[a:b].max() < 256 else size[a:b]).tobytes() for a, b in places]
            yield pa.RecordBatch.from_arrays([pa.array(bundle), pa.array(low, pa.binary()), pa.array(counts, pa.binary())], names=["bundle", "keys", "counts"])
            vocabulary.clear()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            parts = []
            for _, keys, counts in rows:
                low, ends = memoryview(keys)[4 * (width - 1):], _ends(keys, width).tolist()
                parts.append((low, np.frombuffer(counts, dtype=np.uint8 if len(counts) == ends[-1] else np.dtype("<u4")), ends))
            for i in range(width):
                low, where = np.unique(_unpacked(b"".join(low[4 * e[i]:4 * e[i + 1]] for low, _, e in parts)), return_inverse=True)
                if len(low):
                    n = np.bincount(where, weights=np.concatenate([n[e[i]:e[i + 1]] for _, n, e in parts]))
                    yield pa.RecordBatch.from_arrays([pa.array([rows[0][0] * width + i], pa.int32()), pa.array([filled_block(low, n)], pa.binary())],
                                                     names=["block", "bits"])

    return (training.select("text").mapInArrow(count, "bundle int, keys binary, counts binary")
            .repartition("bundle").sortWithinPartitions("bundle").mapInArrow(merge, "block int, bits binary"))


@dataclass(frozen=True)
class LogFrequencyFilter:
    """Packed blocks in one array: block b has the bits ``start[b]`` to ``start[b] + size[b]``."""

    start: np.ndarray
    size: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, blocks: int, rows: Iterable[tuple[int, bytes]]) -> LogFrequencyFilter:
        size, parts = np.zeros(blocks, dtype=np.int64), dict(rows)
        for block, data in parts.items():
            size[block] = 8 * len(data)
        joined = b"".join(parts[b] for b in sorted(parts))
        return cls(np.cumsum(size) - size, size, np.frombuffer(joined, dtype=np.uint8))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels, from the lowest on, probing finds of each key."""
        return self.probe(*split_keys(keys, len(self.size)))

    def probe(self, block: np.ndarray, low: np.ndarray) -> np.ndarray:
        """``levels`` of keys that are split already."""
        found = np.zeros(len(low), dtype=np.uint8)
        at = np.flatnonzero(self.size[block])
        for level in range(LEVELS):
            there, b = np.ones(len(at), dtype=bool), block[at]
            for place in _places(low[at], level, self.size[b]):
                place = place + self.start[b]
                there &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            at = at[there]
            if not len(at):
                break
            found[at] = level + 1
        return found


def quantised(levels: np.ndarray) -> np.ndarray:
    """The count that a number of levels stands for: 0, or the middle of [2^q, 2^(q+1)) for the highest level q."""
    return np.where(levels > 0, np.maximum(1.5 * np.exp2(levels - 1.0) - 0.5, 1.0), 0.0)


def head_cut(counts: DataFrame, most: int, most_bytes: int = HEAD_BYTES) -> int:
    """The least count that at most ``most`` tokens of ``most_bytes`` bytes reach (from a histogram of 16 steps an octave)."""
    step = F.floor(F.log2("n") * 16)
    rows = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.octet_length("token")).alias("bytes"),
                                               F.min("n").alias("least")).orderBy(F.desc("s")).collect()
    total, size, cut = 0, 0, 1 << 62
    for r in rows:
        total, size = total + r["tokens"], size + r["bytes"]
        if total > most or size > most_bytes:
            break
        cut = r["least"]
    return cut


class _TokenFacts:
    """What a task knows of the tokens it has met, by their number."""

    def __init__(self, check: np.ndarray, crc: np.ndarray, known: np.ndarray, whole: float):
        self.check, self.crc, self.known, self.whole = check, crc, known, whole
        self.vocabulary, self.words = Vocabulary(), []
        self.forget()

    def forget(self) -> None:
        self.vocabulary.clear()
        self.words.clear()
        self.h, self.there, self.logs = (np.zeros(0, dtype=t) for t in (np.uint64, bool, float))

    def learn(self) -> None:
        """Hash, whether in the head, and base log probability (0 outside the head) of new tokens."""
        new = list(islice(self.vocabulary, len(self.words), None))
        if not new:
            return
        h, own = _hashes(new), np.fromiter(map(zlib.crc32, new), np.uint32, len(new))
        there, exact = np.zeros(len(new), dtype=bool), np.zeros(len(new))
        if len(self.check):
            place = np.minimum(np.searchsorted(self.check, h), len(self.check) - 1)
            there = (self.check[place] == h) & (self.crc[place] == own)
            exact = np.where(there, self.known[place], 0)
        self.words += new
        self.h = np.concatenate((self.h, h))
        self.there = np.concatenate((self.there, there))
        self.logs = np.concatenate((self.logs, np.where(there, np.log10((exact + 0.5) / self.whole), 0.0)))

    def tails(self, numbers: np.ndarray, docs: np.ndarray, n_docs: int) -> pa.ListArray:
        """(token, n) lists, one for each document, of the tokens outside the head."""
        pairs, n = np.unique(docs.astype(np.int64) << 32 | numbers, return_counts=True)
        tokens = pa.array([self.words[i] for i in (pairs & 0xFFFFFFFF).tolist()], pa.binary())
        offsets = np.searchsorted(pairs >> 32, np.arange(n_docs + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([tokens, pa.array(n.astype(np.int64))], ["token", "n"]))


def _read(batches: Iterator[pa.RecordBatch], facts: _TokenFacts, row: int, chunk: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list]]:
    """First row, token hashes, token numbers, sizes and the facts' columns of each chunk of documents; rows count from ``row``."""
    for batch in _let_go(batches):
        at = 0
        for docs in _numbered((t.as_py() for t in batch.column(2)), facts.vocabulary, chunk):
            facts.learn()
            flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
            first = np.cumsum(sizes) - sizes
            there = np.bincount(flat, minlength=len(facts.h)) > 0
            number = np.cumsum(there) - 1  # within the chunk
            in_head = facts.there[flat]
            yield row, facts.h[there], number[flat], sizes, [
                pa.array(np.arange(row, row + len(docs))), batch.column(0)[at:at + len(docs)], batch.column(1)[at:at + len(docs)],
                pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat(in_head.astype(np.int64), first)),
                pa.array(np.add.reduceat(facts.logs[flat], first)),
                facts.tails(flat[~in_head], np.repeat(np.arange(len(docs)), sizes)[~in_head], len(docs))]
            at += len(docs)
            row += len(docs)
            if len(facts.vocabulary) > FACTS:  # else the next documents reuse what is known
                facts.forget()


class _Chunk:
    """The distinct n-grams of a chunk of documents, in the order of their keys."""

    def __init__(self, h: np.ndarray, numbers: np.ndarray, sizes: np.ndarray):
        self.sizes, self.numbers = sizes, numbers
        self.first = np.cumsum(self.sizes) - self.sizes
        self.before = np.concatenate(([0], self.numbers[:-1]))
        pairs = (self.before + 1) << 32 | self.numbers
        pairs[self.first] = self.numbers[self.first]  # a text's first token has no token before it
        pairs, self.pair = np.unique(pairs, return_inverse=True)
        h_before = np.where(pairs >> 32 > 0, h[np.maximum((pairs >> 32) - 1, 0)], _U(0))
        keys = np.concatenate((unigram_keys(h), bigram_keys(h_before, h[pairs & 0xFFFFFFFF])))
        self.order, self.n_single = np.argsort(keys, kind="stable"), len(h)
        self.keys = keys[self.order]

    @classmethod
    def read(cls, hashes: bytes, numbers: bytes, sizes: list[int]) -> _Chunk:
        return cls(np.frombuffer(hashes, dtype=np.uint64), _from_planes(numbers), np.array(sizes))

    def scores(self, levels: np.ndarray, whole: float) -> np.ndarray:
        """The score of each document, from the filter's levels of the n-grams."""
        count = np.empty(len(levels))
        count[self.order] = quantised(levels)
        single, pair = count[:self.n_single], count[self.n_single:][self.pair]
        alone = (single[self.numbers] + 0.5) / whole
        c_before = np.maximum(single[self.before], pair)
        c_before[self.first] = 0
        chain = np.divide(pair, c_before, out=np.zeros(len(pair)), where=c_before > 0)
        p = np.where(c_before > 0, BIGRAM_SHARE * chain + (1 - BIGRAM_SHARE) * alone, alone)
        return np.add.reduceat(np.log10(np.minimum(p, 1.0)), self.first)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte by byte, all lowest bytes first: the upper bytes are mostly 0."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def filter_levels(chunks: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """(chunk, bundle, levels): the filter's levels of each chunk's n-grams, in the order of their keys, compressed."""
    width = bundle_width(blocks)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, hashes, numbers, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                bundle, _, low = _by_block(_Chunk.read(hashes, numbers, sizes).keys, blocks, width)
                yield pa.RecordBatch.from_arrays([pa.array(bundle), pa.array(np.full(len(bundle), number)), pa.array(low, pa.binary())],
                                                 names=["bundle", "chunk", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, own, asked, size = None, {}, None, [], 0

        def probed() -> pa.RecordBatch:
            ends = [_ends(data, width) for _, data in asked]
            block = np.concatenate([np.repeat(np.arange(width), np.diff(e)) for e in ends])
            levels = own.probe(block, _unpacked(b"".join(data[4 * (width - 1):] for _, data in asked)))
            found = [zlib.compress(x.tobytes(), 1) for x in np.split(levels, np.cumsum([e[-1] for e in ends])[:-1])]
            out = [pa.array([c for c, _ in asked], pa.int64()), pa.array(np.full(len(asked), at, dtype=np.int32)), pa.array(found, pa.binary())]
            asked.clear()
            return pa.RecordBatch.from_arrays(out, names=["chunk", "bundle", "levels"])

        for batch in batches:  # a bundle's blocks have chunks below 0 and so come before those that ask
            for bundle, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle != at:
                    if asked:
                        yield probed()
                    at, parts, own, size = bundle, {}, None, 0
                if chunk < 0:
                    parts[chunk + width] = data
                    continue
                if own is None:
                    own, parts = LogFrequencyFilter.of(width, parts.items()), {}
                asked.append((chunk, data))
                size += len(data) // 4
                if size >= ASKED:
                    yield probed()
                    size = 0
        if asked:
            yield probed()

    asked = chunks.select("chunk", "hashes", "numbers", "sizes").mapInArrow(ask, "bundle int, chunk long, data binary")
    held = filter_blocks.select(F.floor(F.col("block") / width).cast("int").alias("bundle"), (F.col("block") % width - width).cast("long").alias("chunk"),
                                F.col("bits").alias("data"))
    return (asked.unionByName(held).repartition("bundle").sortWithinPartitions("bundle", "chunk")
            .mapInArrow(answer, "chunk long, bundle int, levels binary"))


def score_chunks(chunks: DataFrame, filter_blocks: DataFrame, blocks: int, whole: float) -> DataFrame:
    """(row, score): a chunk meets the levels of its n-grams, and each of its documents gets its score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(chunk: _Chunk, row: int, levels: list[bytes]) -> pa.RecordBatch:
            found = chunk.scores(np.frombuffer(b"".join(map(zlib.decompress, levels)), dtype=np.uint8), whole)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(found))), pa.array(found)], names=["row", "score"])

        chunk, row, levels = None, 0, []
        for batch in batches:
            for i, (bundle, part) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if bundle >= 0:
                    levels.append(part)
                    continue
                if chunk is not None:
                    yield scored(chunk, row, levels)
                row, hashes, numbers, sizes = (batch.column(c)[i].as_py() for c in (0, 3, 4, 5))
                chunk, levels = _Chunk.read(hashes, numbers, sizes), []
        if chunk is not None:
            yield scored(chunk, row, levels)

    none = F.lit(None)
    own = chunks.select("chunk", F.lit(-1).alias("bundle"), none.cast("binary").alias("levels"), "hashes", "numbers", "sizes")
    found = filter_levels(chunks, filter_blocks, blocks).select("chunk", "bundle", "levels", none.cast("binary").alias("hashes"), none.cast("binary").alias("numbers"),
                                         none.cast("array<int>").alias("sizes"))
    return own.unionByName(found).repartition("chunk").sortWithinPartitions("chunk", "bundle").mapInArrow(score, "row long, score double")


def score_texts(docs: DataFrame, held_out_fold: int = 1, head: int = HEAD, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = keyed(docs)
    training = rows.where(fold(F.col("doc_id")) != held_out_fold)
    counts = cut_lineage(count_tokens(training), let_go=True)
    seen = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = seen["n"] or 0, seen["v"]
    cut = head_cut(counts, head)
    frequent = counts.where(F.col("n") >= cut).select("token", "n").toArrow()  # at most ``head`` rows of ``HEAD_BYTES``
    words = frequent.column("token").to_pylist()
    check = _hashes(words)
    order = np.argsort(check)
    check, known = check[order], np.array(frequent.column("n").to_numpy())[order]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))[order]
    del frequent, words
    blocks = block_number(total)
    filter_blocks = cut_lineage(build_blocks(training, blocks), let_go=True)
    size = filter_blocks.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    sent_whole = size <= filter_bytes
    whole_filter = LogFrequencyFilter.of(blocks, ((r["block"], r["bits"]) for r in filter_blocks.toLocalIterator())) if sent_whole else None
    # the head is bounded by ``head`` and ``HEAD_BYTES``, the filter by ``filter_bytes``
    model = docs.sparkSession.sparkContext.broadcast((check, crc, known, whole_filter))
    del whole_filter
    whole = total + 0.5 * (distinct + 1)
    id_type = dict(docs.dtypes)["doc_id"]
    facts_type = f"row long, doc_id {id_type}, text_key long, n_tokens long, n_head long, base double, tail array<struct<token: binary, n: long>>"

    def read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list]]:
        check, crc, known, _ = model.value
        return _read(batches, _TokenFacts(check, crc, known, whole), TaskContext.get().partitionId() << 40, size)  # a chunk has the number of its first row

    names = ["row", "doc_id", "text_key", "n_tokens", "n_head", "base", "tail"]

    def score_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, numbers, sizes, facts in read(batches, HERE_CHUNK):
            chunk = _Chunk(h, numbers, sizes)
            yield pa.RecordBatch.from_arrays([*facts, pa.array(chunk.scores(model.value[3].levels(chunk.keys), whole))], names=[*names, "score"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, h, numbers, sizes, facts in read(batches, SCORE_CHUNK):
            yield pa.RecordBatch.from_arrays([
                pa.array([row]), pa.array([h.tobytes()], pa.binary()), pa.array([_planes(numbers)], pa.binary()),
                pa.array([sizes.tolist()], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.StructArray.from_arrays(facts, names))],
                names=["chunk", "hashes", "numbers", "sizes", "docs"])

    texts = rows.select("doc_id", "text_key", "text")
    if sent_whole:
        own = cut_lineage(texts.mapInArrow(score_here, facts_type + ", score double"))
        scored = own.drop("tail")
    else:
        chunks = cut_lineage(texts.mapInArrow(
            encode, f"chunk long, hashes binary, numbers binary, sizes array<int>, docs array<struct<{facts_type}>>"))
        own = chunks.select(F.inline("docs"))
        scored = own.drop("tail").join(score_chunks(chunks, filter_blocks, blocks, whole), "row")
    rest = own.select("row", F.inline("tail")).join(counts.where(F.col("n") < cut).select("token", F.col("n").alias("c")), "token", "left")
    c = F.coalesce("c", F.lit(0))
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.log10((c + 0.5) / whole)).alias("rest"),
                                   F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_rest"))
    return scored.join(rest, "row", "left").select(
        "doc_id", "text_key", F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")
