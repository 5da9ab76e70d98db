"""Quality rules: fixed limits on counts, then a likelihood ratio of hashed n-grams.

The ratio compares two multinomials over ``BUCKETS`` hashed one- and two-word
n-grams: the trusted target (documents of label quality 1) against the raw corpus
(every document).  One scan adds up both count tables; a task sends at most one
row a bucket, and the tables that reach the driver and the workers have a fixed size.
A document's score is the sum of its n-grams' weights over their number.  Weights
are whole thousandths of a nat, so a score hangs on no order of rows or words.
The threshold is ``QUANTILE`` of the trusted documents' scores less ``MARGIN``;
every document is held against it, none is drawn by chance.

Both sides are counted whole: the raw corpus over every row, the target and the
threshold over every trusted document.  Up to ``SENT`` labelled ids reach the tasks
by a broadcast; beyond that the join that marks the texts is left to Spark.  The
rows are measured once and written narrow; threshold and verdict read them.
A caller may bound the labelled ids by ``trusted`` (chosen by a hash).

Null texts have no words.  Texts without words fail the base rules and have a null
score.  Without a trusted document the weights are 0 and nothing but the base
rules applies.  Rows are judged one by one: repeated rows get equal results, ids
may be null.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bounded_share, keyed

BUCKETS, QUANTILE, MARGIN = 1 << 16, 0.001, 60
SENT = 2_000_000  # ids in a broadcast
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
# fixed values: white space between words, and the symbols that are counted
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_INSIDE_CHAR = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no character
_VOCABULARY = 1 << 20


class _Words(dict):
    """Word -> number, in order of first sight; ``hashes`` holds 32 bits of each lower-cased word's MD5."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.hashes.append(int.from_bytes(hashlib.md5(word.lower(), usedforsecurity=False).digest()[:4], "big"))
        return number


def grams_of(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and the word pairs of a text."""
    return np.concatenate([hashes % buckets, (31 * hashes[:-1] + hashes[1:] + 1) % buckets])


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words stand in a window that occurs more than once."""
    if len(ids) <= window:
        return 0
    n = len(ids) - window + 1
    code = ids[:n]
    for k in range(1, window):  # numbers of equal prefixes; exact for any vocabulary
        code = np.unique((code << 31) | ids[k:n + k], return_inverse=True)[1]
    again = np.bincount(code)[code] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(window):
        covered[k:n + k] |= again
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _read(column: pa.ChunkedArray | pa.Array, words: _Words) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(text, word numbers, word hashes) of every text; the vocabulary is bounded between texts."""
    for value in column:
        data = value.as_py()
        if len(words) > _VOCABULARY:
            words.clear()
            words.hashes.clear()
        ids = np.fromiter(map(words.__getitem__, data.split()), dtype=np.int64)
        used, place = np.unique(ids, return_inverse=True)
        yield data, ids, np.array([words.hashes[i] for i in used.tolist()], dtype=np.int64)[place] if len(ids) else ids


def count_grams(texts: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the raw corpus and of the target by bucket; ``texts``: text, trusted."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = _Words(), np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            for trusted, (_, _, hashes) in zip(batch.column(1).to_pylist(), _read(batch.column(0), words), strict=True):
                own = np.bincount(grams_of(hashes, buckets), minlength=buckets) if len(hashes) > buckets else None
                for k in (0, 1) if trusted else (0,):
                    if own is None:
                        np.add.at(found[k], grams_of(hashes, buckets), 1)
                    else:
                        found[k] += own
        seen = np.flatnonzero(found[0])
        yield pa.record_batch({"bucket": pa.array(seen, pa.int64()), "raw": found[0][seen], "target": found[1][seen]})

    sums = (texts.select(F.col("text").cast("binary").alias("text"), "trusted").mapInArrow(count, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    raw[sums["bucket"].to_numpy()], target[sums["bucket"].to_numpy()] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    return raw, target


def gram_weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of every bucket with one count added, in whole thousandths of a nat, rounded down."""
    if not target.sum():
        return np.zeros(len(raw), dtype=np.int64)
    more = (float(raw.sum()) + len(raw)) / (float(target.sum()) + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) / (r + 1.0) * more)) for r, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def measure(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr of (doc_id, text_key, text)."""
    sent = texts.sparkSession.sparkContext.broadcast(weights)  # a fixed number of buckets

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weight = _Words(), sent.value
        for batch in batches:
            out = []
            for data, ids, hashes in _read(batch.column(2), words):
                n = len(ids)
                llr = int(weight[grams_of(hashes, len(weight))].sum()) // (2 * n - 1) if n else None
                out.append((n, len(data.translate(None, SPACE + _INSIDE_CHAR)), len(data) - len(data.translate(None, SYMBOLS)),
                            repeated_lines(data), repeated_words(ids), llr))
            cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 6
            yield pa.record_batch([batch.column(0), batch.column(1), *cols], names=names)

    names = ["doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text_key", F.col("text").cast("binary").alias("text")).mapInArrow(
        rows, f"doc_id {id_type}, text_key long, " + ", ".join(f"{c} long" for c in names[2:]))


def least_score(trusted: DataFrame, quantile: float = QUANTILE, margin: int = MARGIN) -> int | None:
    """The score that a document needs; ``trusted`` has the ``llr`` of the trusted documents."""
    found = sorted(trusted.where("llr IS NOT NULL").groupBy("llr").agg(F.count(F.lit(1)).alias("n")).collect())
    place, seen = math.floor(quantile * sum(n for _, n in found)), 0
    for score, n in found:
        seen += n
        if seen > place:
            return score - margin
    return None


def apply_rules(docs: DataFrame, labels: DataFrame, trusted: int | None = None, quantile: float = QUANTILE, margin: int = MARGIN,
                buckets: int = BUCKETS) -> DataFrame:
    """doc_id, text_key, the five counts, base_failed, kept, llr, least_llr: see the module's text."""
    texts = keyed(docs)
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    if trusted is not None:
        ids = bounded_share(ids, F.col("__id"), trusted).orderBy(F.xxhash64("__id"), "__id").limit(2 * trusted)
    ids = cut_lineage(ids)
    if ids.count() <= SENT:
        ids = F.broadcast(ids)
    flagged = texts.join(ids, texts["doc_id"] == F.col("__id"), "left")
    weights = gram_weights(*count_grams(flagged.select("text", F.col("__id").isNotNull().alias("trusted")), buckets))
    measured = cut_lineage(measure(texts, weights))  # a few numbers a document
    least = least_score(measured.join(ids, measured["doc_id"] == F.col("__id"), "left_semi").where(F.col("n_words") >= MIN_WORDS), quantile, margin)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    verdict = F.lit(True) if least is None else F.coalesce(F.col("llr") >= least, F.lit(False))
    return measured.select(
        "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict).alias("kept"), "llr", F.lit(least).cast("long").alias("least_llr"))
