"""Quality classifier learned from positive and unlabelled text (nnPU).

Trusted positives are labelled rows of quality 1 (labels of quality 0 are never
read), unlabelled text is any document, whatever its label.  Statistics of every
text are taken once and kept in a narrow table.
1. Their cuts are quantiles over all rows of the training folds, on a grid of 1 / ``GRID``.
2. A first model separates positives from unlabelled text; the class prior is the
   best bin estimate: the least ratio of the shares of unlabelled and positive
   documents above a score.  It counts all training rows of the half that the model
   has not seen.
3. The classifier minimises the non-negative unbiased risk
   prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)]) with the logistic loss,
   over samples of at most 2 * ``sample`` distinct (id, text) of each kind, chosen by
   a hash.

A score uses the text only.  Null and empty texts are scored like any other; without a
trusted positive every score is the prior 0.5.  Rows are scored one by one, so
repeated rows get equal scores; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bounded_rows, bounded_share, fold, keyed

SAMPLE, BINS, THRESHOLD = 8000, 12, 0.3
GRID, FAR = 512, 64.0  # values from FAR on count as FAR
STEPS, L2 = 1000, 1e-5
NAMES = ("chars", "letters", "upper", "digits", "marks", "spaces", "distinct words", "word length", "same as next",
         "distinct lines", "line length", "bare marks", "shouted words", "marked words")
# character classes of UTF-8 bytes; bytes above 127 belong to letters
_CLASS = np.zeros(256, dtype=np.uint8)
for _first, _last, _kind in ((33, 126, 4), (48, 57, 3), (65, 90, 2), (97, 122, 1), (128, 255, 1), (9, 13, 5), (32, 32, 5)):
    _CLASS[_first:_last + 1] = _kind


def statistics(text: str) -> list[float]:
    """One number for each of NAMES."""
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=6)
    size = max(len(data), 1)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    bare = sum(not w[0].isalnum() and not w[-1].isalnum() for w in words)
    return [np.log1p(len(data)), kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size,
            len(set(words)) / n, len(data) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines),
            np.log1p(len(data) / len(lines)), bare / n, sum(map(str.isupper, words)) / n,
            sum(not w[-1].isalnum() for w in words) / n]


@dataclass(frozen=True)
class QualityModel:
    cuts: tuple[np.ndarray, ...]
    weights: np.ndarray
    prior: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-_design(stats, self.cuts) @ self.weights))


def _design(stats: np.ndarray, cuts: tuple[np.ndarray, ...]) -> np.ndarray:
    """One-hot bins of every statistic, and a constant."""
    parts = [np.eye(len(c) + 1)[np.searchsorted(c, stats[:, i], side="right")] for i, c in enumerate(cuts)]
    return np.hstack([*parts, np.ones((len(stats), 1))])


def _descend(slope, size: int, steps: int, rate: float = 0.2) -> np.ndarray:
    """Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = slope(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def class_prior(positive: np.ndarray, at: np.ndarray, above: np.ndarray, total: float, delta: float = 0.1) -> float:
    """Best bin estimate from the positives' scores and how many of ``total`` unlabelled documents score ``at`` or more."""
    p = 1 - np.searchsorted(np.sort(positive), at, side="left") / len(positive)
    u = above / total
    slack = np.sqrt(np.log(4 / delta) / (2 * len(positive))) + np.sqrt(np.log(4 / delta) / (2 * total))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit_apart(positive: np.ndarray, unlabelled: np.ndarray, cuts: tuple[np.ndarray, ...], steps: int = STEPS) -> np.ndarray:
    """Weights that tell positives from unlabelled documents."""
    a, b = _design(positive, cuts), _design(unlabelled, cuts)

    def apart(w):
        return a.T @ (_sigmoid(a @ w) - 1) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + 1e-2 * w

    return _descend(apart, a.shape[1], steps)


def fit(positive: np.ndarray, unlabelled: np.ndarray, cuts: tuple[np.ndarray, ...], prior: float, steps: int = STEPS, l2: float = L2) -> QualityModel:
    """Minimise the non-negative risk on the statistics of both samples, in any fixed order."""
    xp, xu = _design(positive, cuts), _design(unlabelled, cuts)

    def risk(w):  # slope of the non-negative risk
        up, uu = _sigmoid(xp @ w), _sigmoid(xu @ w)
        as_negative = -np.log1p(-np.minimum(uu, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(up, 1 - 1e-12)).mean()
        negative = xu.T @ uu / len(xu) - prior * (xp.T @ up) / len(xp)
        if as_negative < 0:  # the estimate of a risk fell below zero: step back
            return -negative
        return prior * (xp.T @ (up - 1)) / len(xp) + negative + l2 * w

    return QualityModel(cuts, _descend(risk, xp.shape[1], steps), prior)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, s (the statistics): one pass over the texts, written."""
    @F.pandas_udf("array<double>")
    def statistics_of(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return cut_lineage(keyed(docs).select("doc_id", "text_key", statistics_of("text").alias("s")))


def quantile_cuts(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """For each statistic the grid values that hold the quantiles of all rows: one aggregate, at most GRID * FAR values each."""
    place = F.floor(F.least("v", F.lit(FAR)) * GRID).cast("int")
    found = rows.select(F.posexplode("s").alias("i", "v")).groupBy("i", place.alias("at")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    which, at, n = (found.column(c).to_numpy() for c in ("i", "at", "n"))
    cuts = []
    for i in range(len(NAMES)):
        own = which == i
        order = np.argsort(at[own])
        upto = np.cumsum(n[own][order])
        wanted = np.linspace(0, 1, BINS + 1)[1:-1] * upto[-1]
        cuts.append(np.unique(at[own][order][np.searchsorted(upto, wanted)]) / GRID)
    return tuple(cuts)


def learn(rows: DataFrame, labels: DataFrame, held_out_fold: int = 0, sample: int = SAMPLE) -> QualityModel | None:
    """Fit on the measured rows outside the held-out fold; at most 2 * ``sample`` rows of either kind reach the driver."""
    training = rows.where(fold(F.col("doc_id")) != held_out_fold)
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("__id")).where(
        fold(F.col("__id")) != held_out_fold).distinct()
    trusted = bounded_share(trusted, F.col("__id"), sample).orderBy(F.xxhash64("__id"), "__id").limit(2 * sample)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id", "text_key"), F.lit(2))
    # the broadcast side holds at most 2 * ``sample`` ids
    kinds = {"p": training.join(F.broadcast(trusted), training["doc_id"] == F.col("__id"), "left_semi"),
             "u": bounded_share(training, F.xxhash64("doc_id", "text_key"), sample)}
    found = {}
    rng = np.random.default_rng(0)  # a fixed order, whatever the partitions
    for k, t in kinds.items():
        got = sorted((r["h"], r["s"]) for r in bounded_rows(t, 2 * sample).select(half.alias("h"), "s").collect())
        order = rng.permutation(len(got))
        found[k] = (np.array([got[i][0] for i in order]), np.array([got[i][1] for i in order]))
    (hp, xp), (hu, xu) = found["p"], found["u"]
    if not len(xp) or not len(xu):
        return None
    cuts = quantile_cuts(training)
    prior = 0.5
    if len(set(hp)) == 2 and (hu == 0).any():
        first = fit_apart(xp[hp == 0], xu[hu == 0], cuts)
        positive = _design(xp[hp == 1], cuts) @ first
        at = np.unique(positive)  # at most 2 * ``sample`` scores

        @F.pandas_udf("int")
        def reached(stats: pd.Series) -> pd.Series:
            if not len(stats):
                return pd.Series([], dtype="int32")
            return pd.Series(np.searchsorted(at, _design(np.stack(stats.to_numpy()), cuts) @ first, side="right").astype(np.int32))

        counts = training.where(half == 1).select(reached("s").alias("k")).groupBy("k").count().collect()
        seen = np.zeros(len(at) + 1)
        for k, n in counts:
            seen[k] = n
        if seen.sum():
            prior = class_prior(positive, at, np.cumsum(seen[::-1])[::-1][1:], seen.sum())
    return fit(xp, xu, cuts, prior)


def score_quality(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted (1 from 0.3 on), prior (the estimated class prior)."""
    rows = measured(docs)
    model = learn(rows, labels, held_out_fold, sample)

    @F.pandas_udf("double")
    def scored(stats: pd.Series) -> pd.Series:
        if model is None or not len(stats):
            return pd.Series(np.full(len(stats), 0.5))
        return pd.Series(model.score(np.stack(stats.to_numpy())))

    rows = rows.select("doc_id", "text_key", scored("s").alias("score"))
    return rows.select("doc_id", "text_key", F.coalesce(fold(F.col("doc_id")) == held_out_fold, F.lit(False)).alias("held_out"),
                       "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                       F.lit(model.prior if model else 0.5).alias("prior"))
