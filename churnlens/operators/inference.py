"""Coefficient inference and linear attributions.

The unregularised logit is fitted by Newton steps; a step is one distributed
aggregate of k numbers and a k x k matrix (k = number of features), so its cost
grows with the rows only through that aggregate.  The inference table itself has
k + 1 rows.

Before the fit, columns that repeat others are found in the information matrix and
left out, each with the columns it combines.  Where the classes are separated the
likelihood has no maximum: the columns of the direction that runs away are named,
and the fit is refused or, on request, made with Jeffreys' prior, whose estimate is
always finite.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cleaning import q
from .exact_sums import exact_moments
from .modeling import ChurnModel, fit_medians, impute

Z975 = 1.959963984540054  # standard-normal 97.5 % quantile

# The coefficient table committed with the original model
# (all rows, 13 features, unregularised logit with intercept).
PUBLISHED_COEFFICIENTS = {
    "const": -0.4915086983837309,
    "Core Industry_Medical": 0.019549051913109624,
    "BundleType_core bundle": 0.3088471574478499,
    "Week 1 Cases": -0.07240013383347535,
    "Week 2 Cases": 0.0010147890048762393,
    "Week 3 Cases": -0.015112925038942824,
    "Week 4 Cases": 0.022177331221866305,
    "Inbound Sms Count Activated": -0.4754536435485947,
    "Outbound Sms Count Activated": 0.04404886551504327,
    "Inbound Call Count Activated": -0.0642281195572106,
    "Outbound Call Count Activated": -0.7873360037898745,
    "Reason Billing Flag": 0.5370505485665978,
    "Reason Data Sync Flag": -0.3774263822646646,
    "PMS_Group_EOD pms": -0.45087899672730297,
}


def coefficient_margin(coefs: dict[str, float], intercept_name: str = "const") -> Column:
    """Linear predictor of a coefficient table over the raw feature columns."""
    z = F.lit(coefs.get(intercept_name, 0.0))
    for name, b in coefs.items():
        if name != intercept_name:
            z = z + F.lit(b) * q(name).cast("double")
    return z


def coefficient_probability(coefs: dict[str, float], intercept_name: str = "const") -> Column:
    """Logistic probability of a coefficient table (e.g. a saved or published model)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-coefficient_margin(coefs, intercept_name)))


def _normal_sf2(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2.0))


@dataclass(frozen=True)
class _Sums:
    """Over all rows at one estimate: likelihood, score, information, and the range of the fitted probabilities."""

    rows: int
    likelihood: float
    score: np.ndarray
    information: np.ndarray
    low: float
    high: float


def _logit_sums(data: DataFrame, beta: np.ndarray, mean: np.ndarray, scale: np.ndarray, inverse: np.ndarray | None = None) -> _Sums:
    """One aggregate over (x, y, n), n rows of each kind; with ``inverse`` (of the information) the score is that of the Jeffreys-penalised likelihood."""
    k = len(beta)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = np.zeros(2 + k + k * k), 1.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.hstack([np.ones((len(raw), 1)), (raw - mean) / scale])
            y, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            z = x @ beta
            p = 1 / (1 + np.exp(-z))
            w = p * (1 - p)
            off = y - p
            if inverse is not None:
                off = off + w * np.einsum("ij,jk,ik->i", x, inverse, x) * (0.5 - p)
            likelihood = -(n * np.logaddexp(0, np.where(y == 1, -z, z))).sum()
            total += np.concatenate(([n.sum(), likelihood], x.T @ (n * off), ((x * (n * w)[:, None]).T @ x).ravel()))
            low, high = min(low, p.min()), max(high, p.max())
        yield pa.record_batch({"sums": pa.array([total.tolist()], pa.list_(pa.float64())), "low": [float(low)], "high": [float(high)]})

    found = data.mapInArrow(part, "sums array<double>, low double, high double")
    ends = found.agg(F.min("low"), F.max("high"), F.array(*[F.sum(F.col("sums")[i]) for i in range(2 + k + k * k)])).first()
    sums = np.array(ends[2] if ends[2] and ends[2][0] is not None else np.zeros(2 + k + k * k))
    return _Sums(int(sums[0]), float(sums[1]), sums[2:2 + k], sums[2 + k:].reshape(k, k), ends[0], ends[1])


def independent_columns(gram: np.ndarray, tolerance: float = 1e-9) -> tuple[list[int], dict[int, dict[int, float]]]:
    """Columns that no earlier ones combine to, and for each other column the kept ones it combines and their factors."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    unit = gram / np.outer(scale, scale)
    kept: list[int] = []
    blamed: dict[int, dict[int, float]] = {}
    for j in range(len(gram)):
        factors = np.linalg.solve(unit[np.ix_(kept, kept)], unit[kept, j]) if kept else np.zeros(0)
        if gram[j, j] <= 0 or unit[j, j] - unit[j, kept] @ factors <= tolerance:
            blamed[j] = {i: float(f * scale[j] / scale[i]) for i, f in zip(kept, factors) if abs(f) > 1e-6}
        else:
            kept.append(j)
    return kept, blamed


def _newton(data: DataFrame, k: int, mean: np.ndarray, scale: np.ndarray, max_iter: int, edge: float = 1e-8) -> tuple[np.ndarray, _Sums, int, bool]:
    """Estimate, sums, steps, and whether it is a maximum: the score is 0 and no fitted probability runs to 0 or 1."""
    beta = np.zeros(k)
    now = _logit_sums(data, beta, mean, scale)
    for step in range(1, max_iter + 1):
        if np.abs(now.score).max() <= 1e-9 * now.rows:
            return beta, now, step - 1, now.low >= edge and now.high <= 1 - edge
        if now.low < edge or now.high > 1 - edge:
            return beta, now, step - 1, False
        move = np.linalg.solve(now.information, now.score)
        while True:
            tried = _logit_sums(data, beta + move, mean, scale)
            if tried.likelihood >= now.likelihood - 1e-9 * abs(now.likelihood) or np.abs(move).max() < 1e-9:
                break
            move = move / 2
        beta, now = beta + move, tried
    return beta, now, max_iter, False


def _jeffreys(data: DataFrame, k: int, mean: np.ndarray, scale: np.ndarray, max_iter: int) -> tuple[np.ndarray, _Sums]:
    """The estimate under Jeffreys' prior, and the sums there: secant steps (BFGS) that begin with the inverse information."""
    def at(beta: np.ndarray) -> tuple[_Sums, float, np.ndarray, np.ndarray]:
        sums = _logit_sums(data, beta, mean, scale)
        inverse = np.linalg.inv(sums.information)
        score = _logit_sums(data, beta, mean, scale, inverse).score
        return sums, sums.likelihood + 0.5 * np.linalg.slogdet(sums.information)[1], score, inverse

    beta = np.zeros(k)
    now, value, score, metric = at(beta)
    for _ in range(max_iter):
        if np.abs(score).max() <= 1e-9 * now.rows:
            return beta, now
        move = metric @ score
        move *= min(1.0, 5.0 / np.abs(move).max())
        while True:
            found = at(beta + move)
            if found[1] >= value - 1e-12 * now.rows or np.abs(move).max() < 1e-12:
                break
            move = move / 2
        change = score - found[2]  # of the score along the move
        beta = beta + move
        now, value, score, inverse = found
        along = float(move @ change)
        if along > 0:
            turn = np.eye(k) - np.outer(move, change) / along
            metric = turn @ metric @ turn.T + np.outer(move, move) / along
        else:
            metric = inverse
    raise ValueError(f"the penalised logit did not converge in {max_iter} steps")


def logit_inference(df: DataFrame, features: Sequence[str], label: str,
                    impute_median: bool = True, max_iter: int = 100, separated: str = "raise") -> DataFrame:
    """Unweighted logit with intercept: coefficient, SE, z, p, 95 % CI, odds ratio, percent odds change per unit, note.

    The intercept row comes first and is named ``const``.  A column that is constant or a combination of others has null
    statistics and a note that names them.  If the classes are separated, ``separated="raise"`` refuses the fit and
    ``"jeffreys"`` estimates with Jeffreys' prior; the columns to blame are named in either case.  Rows with a null are
    left out.
    """
    names = ["const", *features]
    data = df.select(*[q(c) for c in features], q(label).cast("double").alias("_y"))
    if impute_median:
        data = impute(data, fit_medians(data, list(features)))
    data = data.na.drop().select(F.array(*[q(c).cast("double") for c in features]).alias("x"), F.col("_y").alias("y"))
    data = cut_lineage(data.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))  # equal rows once: flags and counts leave few
    classes = {r[0] for r in data.groupBy("y").count().collect()}
    if not classes <= {0.0, 1.0} or not classes or (separated == "raise" and len(classes) < 2):
        raise ValueError(f"the logit needs labels 0 and 1, got {sorted(classes)}")
    moments = list(exact_moments(data, {str(i): F.col("x")[i] for i in range(len(features))}).values())
    mean = np.array([m for _, m, _ in moments])  # of the kinds of rows: any centre and scale will do
    scale = np.array([s or 1.0 for _, _, s in moments])
    everything = _logit_sums(data, np.zeros(len(names)), mean, scale)
    kept, blamed = independent_columns(everything.information)
    notes = {names[j]: "combination of " + ", ".join(names[i] for i in by if i) if any(by) else "constant" for j, by in blamed.items()}
    own = [i - 1 for i in kept if i]
    part = data.select(F.array(*[F.col("x")[i] for i in own]).cast("array<double>").alias("x"), "y", "n") if len(own) < len(features) else data
    mean, scale, k = mean[own], scale[own], len(kept)
    beta, now, steps, maximum = _newton(part, k, mean, scale, max_iter)
    if not maximum:
        size = np.sqrt(np.diag(now.information))
        direction = np.linalg.eigh(now.information / np.outer(size, size))[1][:, 0] / size  # the least information
        away = np.abs(direction * np.concatenate(([1.0], np.ones(k - 1))))
        guilty = [names[j] for j, a in zip(kept, away) if a >= 0.25 * away.max()]
        if separated == "raise":
            raise ValueError("the logit has no finite estimate: a combination of features separates the classes "
                             f"({', '.join(guilty)}; fitted probabilities from {now.low:.3g} to {now.high:.3g} after {steps} iterations)")
        notes |= {g: "separates the classes" for g in guilty}
        beta, now = _jeffreys(part, k, mean, scale, max_iter)
    back = np.eye(k)  # from standardised columns to the columns as they are
    back[0, 1:] = -mean / scale
    back[np.arange(1, k), np.arange(1, k)] = 1 / scale
    coefficient, errors = back @ beta, np.sqrt(np.diag(back @ np.linalg.inv(now.information) @ back.T))
    at = {names[j]: (float(b), float(e)) for j, b, e in zip(kept, coefficient, errors)}
    rows = []
    for name in [names[0], *[n for n in names[1:] if n in at], *[n for n in names[1:] if n not in at]]:
        b, e = at.get(name, (None, None))
        z = None if b is None else b / e
        rows.append((name, b, e, z, None if z is None else _normal_sf2(z), notes.get(name)))
    spark = SparkSession.getActiveSession()
    t = spark.createDataFrame(rows, "variable STRING, coefficient DOUBLE, std_err DOUBLE, z_score DOUBLE, p_value DOUBLE, note STRING")
    return inference_columns(t)


def inference_columns(t: DataFrame) -> DataFrame:
    """CI, odds ratio and percent change from (coefficient, std_err)."""
    b, se = F.col("coefficient"), F.col("std_err")
    return t.select("*", (b - F.lit(Z975) * se).alias("ci_low"), (b + F.lit(Z975) * se).alias("ci_high"),
                    F.exp(b).alias("odds_ratio"), ((F.exp(b) - 1.0) * 100.0).alias("pct_odds_change_per_unit"))


def background_means(df: DataFrame, features: Sequence[str], n: int | None = None, seed: int = 42,
                     key: str = "row_id") -> dict[str, float]:
    """Feature means over all rows, or over a background sample of ``n`` rows if one is asked for.

    The sample (a sampling option of the original) is the ``n`` rows with the
    smallest seeded hash of the row key, so it is reproducible.
    """
    h = F.md5(F.concat_ws("|", q(key).cast("string"), F.lit(str(seed))))
    bg = df.select(*[q(c).cast("double").alias(c) for c in features], h.alias("_h"), q(key).alias("_k"))
    if n is not None:
        bg = bg.orderBy("_h", "_k").limit(n)
    row = bg.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return {c: float(row[f"m{i}"]) for i, c in enumerate(features)}


def linear_attributions(df: DataFrame, coefs: dict[str, float], means: dict[str, float],
                        keep: Sequence[str] = ()) -> DataFrame:
    """phi_j = b_j * (x_j - background mean of x_j) per row, plus base value and margin."""
    phis = {f"phi_{c}": F.lit(coefs[c]) * (q(c).cast("double") - F.lit(means[c])) for c in means}
    base = coefs.get("const", 0.0) + sum(coefs[c] * m for c, m in means.items())
    return df.select(*[q(k) for k in keep], *[v.alias(k) for k, v in phis.items()],
                     F.lit(base).alias("base_value"),
                     coefficient_margin({"const": coefs.get("const", 0.0),
                                         **{c: coefs[c] for c in means}}).alias("margin"))


def model_attributions(df: DataFrame, model: ChurnModel, background: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Contributions of each feature to the fitted model's margin, against the means of ``background``.

    phi_j = b_j * (x_j - mean of x_j) / std_j on imputed features; they and the base value, the background's mean
    margin, add up to the row's margin.
    """
    means = exact_moments(background, {c: model.prepared(c) for c in model.features})
    weight = {c: b / model.scaler[c][1] for c, b in zip(model.features, model.coefficients)}
    phis = {f"phi_{c}": F.lit(w) * (model.prepared(c) - F.lit(means[c][1])) for c, w in weight.items()}
    base = model.intercept + sum(w * (means[c][1] - model.scaler[c][0]) for c, w in weight.items())
    return df.select(*[q(k) for k in keep], *[v.alias(k) for k, v in phis.items()], F.lit(base).alias("base_value"), model.margin().alias("margin"))
