"""A fitted low-rank text model: vectors of texts in which words of like use are near each other.

Rows are texts, columns the ``words`` most frequent words by number of texts; a cell
is the word's count times its inverse document frequency, a row has length 1.  A
randomised range finder looks for the directions that hold most of the matrix: a
fixed random block of columns is multiplied by the matrix and its transpose a few
times, orthonormalised in between, and rotated to principal axes at the end.  A
multiplication is one pass: a task adds up its texts' contributions and sends one
row a word, so what is shuffled and what reaches the driver have the size of the
model (words x dimensions), whatever the number of texts.

A text's vector is its row times the axes, scaled to length 1; a text without known
words is the zero vector.  The random block is drawn from a seed, so a fit over the
same texts differs by rounding only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cleaning import q

WORDS, ROUNDS, SPARE, SEED = 20_000, 4, 8, 42
_GAP = re.compile(r"[^0-9a-z_]+")


def words_column(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^0-9a-z_]+"), "")


@dataclass(frozen=True)
class TextModel:
    """Words in order, their inverse document frequencies, and the axes (words x dimensions)."""

    words: tuple[str, ...]
    idf: np.ndarray
    axes: np.ndarray

    def __post_init__(self):
        object.__setattr__(self, "_place", {w: i for i, w in enumerate(self.words)})

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text's known words; the values have length 1."""
        counts = Counter(w for w in _GAP.split((text or "").lower()) if w in self._place)
        at = np.array([self._place[w] for w in counts], dtype=np.int64)
        value = np.array(list(counts.values()), dtype=float) * self.idf[at]
        size = np.sqrt((value * value).sum())
        return at, value / size if size else value

    def project(self, text: str | None) -> np.ndarray:
        at, value = self.row(text)
        return value @ self.axes[at]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Vectors of length 1, one for each text (an ``Embedder`` of ``segments``)."""
        found = np.array([self.project(t) for t in texts]).reshape(len(texts), -1)
        size = np.sqrt((found * found).sum(axis=1, keepdims=True))
        return found / np.where(size > 0, size, 1.0)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, w, float(f), [float(x) for x in v]) for i, (w, f, v) in enumerate(zip(self.words, self.idf, self.axes))]
        spark.createDataFrame(rows, "place INT, word STRING, idf DOUBLE, axis ARRAY<DOUBLE>").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        rows = spark.read.parquet(path).orderBy("place").collect()  # as many as the model has words
        return cls(tuple(r["word"] for r in rows), np.array([r["idf"] for r in rows]), np.array([r["axis"] for r in rows]).reshape(len(rows), -1))


def _vocabulary(texts: DataFrame, words: int) -> tuple[tuple[str, ...], np.ndarray]:
    """The most frequent words by number of texts (ties by word) and their inverse document frequencies."""
    total = texts.count()
    held = texts.select(F.explode(F.array_distinct(words_column(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = held.orderBy(F.desc("n"), "word").limit(words).collect()
    return tuple(r["word"] for r in top), np.array([np.log((1 + total) / (1 + r["n"])) + 1 for r in top])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str | None]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def _multiply(texts: DataFrame, model: TextModel) -> np.ndarray:
    """The matrix, transposed, times the matrix times the axes: one pass."""
    sent = texts.sparkSession.sparkContext.broadcast(model)  # words x dimensions numbers
    width = model.axes.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        total = np.zeros(m.axes.shape)
        for text in _texts(batches):
            at, value = m.row(text)
            total[at] += np.outer(value, value @ m.axes[at])
        seen = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.record_batch([pa.array(seen, pa.int32()), *[pa.array(total[seen, j]) for j in range(width)]], names=["place", *[f"v{j}" for j in range(width)]])

    sums = texts.mapInArrow(part, "place int, " + ", ".join(f"v{j} double" for j in range(width))).groupBy("place").agg(
        *[F.sum(f"v{j}").alias(f"v{j}") for j in range(width)]).toArrow()
    out = np.zeros(model.axes.shape)
    out[sums.column("place").to_numpy()] = np.stack([sums.column(f"v{j}").to_numpy() for j in range(width)], axis=1)
    return out


def fit_text_model(df: DataFrame, text: str, dims: int, words: int = WORDS, rounds: int = ROUNDS, spare: int = SPARE, seed: int = SEED) -> TextModel:
    """Fit on all texts of a column; null texts are empty.  Fewer words than ``dims`` give as many dimensions as words."""
    texts = df.select(q(text).cast("string").alias("text"))
    vocabulary, idf = _vocabulary(texts, words)
    if not vocabulary:
        return TextModel((), np.zeros(0), np.zeros((0, dims)))
    width = min(dims + spare, len(vocabulary))
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(vocabulary), width)))
    for _ in range(rounds):
        basis, _ = np.linalg.qr(_multiply(texts, TextModel(vocabulary, idf, basis)))
    # energies along the principal axes of what the basis holds
    energy, turn = np.linalg.eigh(basis.T @ _multiply(texts, TextModel(vocabulary, idf, basis)))
    axes = (basis @ turn)[:, np.argsort(-energy, kind="stable")][:, :dims]
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])  # the largest entry of an axis is positive
    return TextModel(vocabulary, idf, axes * np.where(sign == 0, 1.0, sign))
