"""Stage 2 modelling: split, impute, scale, class weights, logistic fit, isotonic
calibration, threshold choice and scoring.

Fitting statistics (medians, means, class counts) are one aggregate job each
and return one row bounded by the number of features.  The model fits are
MLlib estimators (tree-aggregated gradients / normal equations), so no row
data is collected to the driver.  The margin is a column expression over the
fitted parameters and stays inside whole-stage codegen; the calibration map is
a table that scores meet in a range join (``isotonic``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cleaning import q
from .evaluation import best_threshold, pr_table
from .exact_sums import exact_moments
from .isotonic import IsotonicFit, fit_isotonic
from .ranking import rank_within_groups
from .selection import exact_quantiles

SPLIT, LABEL, WEIGHT = "split", "churn_flag", "class_weight"
SPLIT_SALT = "split-42"
TWO32 = 4294967296.0


# --------------------------------------------------------------------------- split
def hash_unit(key: str | Column, salt: str = SPLIT_SALT) -> Column:
    """Uniform value in [0, 1) from the md5 of the key and a salt (same in any engine)."""
    k = q(key) if isinstance(key, str) else key
    h = F.md5(F.concat_ws("|", k.cast("string"), F.lit(salt)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(TWO32)


def split_sizes(n: int, test_size: float = 0.20, val_size: float = 0.25) -> tuple[int, int]:
    """(test, val) row counts of one class: round(test_size * n), then round(val_size * rest),
    halves rounded up, computed in exact arithmetic."""
    half = Fraction(1, 2)
    n_test = math.floor(Fraction(str(test_size)) * n + half)
    n_val = math.floor(Fraction(str(val_size)) * (n - n_test) + half)
    return n_test, n_val


def stratified_split(df: DataFrame, key: str = "row_id", test_size: float = 0.20,
                     val_size: float = 0.25, salt: str = SPLIT_SALT, col: str = SPLIT,
                     label: str | None = LABEL) -> DataFrame:
    """Label rows train / val / test, stratified by ``label`` with exact per-class sizes.

    Inside each class rows are ordered by a seeded md5 of the key (then the
    key); the first ``round(test_size * n_c)`` go to test, the next
    ``round(val_size * rest)`` to validation.  Positions come from the
    range-partitioned ``rank_within_groups`` over (key, label, hash) rows, so a
    class holding most rows is still cut across many tasks; only the class
    counts (one row per class) reach the driver.  Rows without a label are a
    class of their own.  The key must be unique.  Without a label column the
    split falls back to fixed cuts of a uniform hash.
    """
    if label is None or label not in df.columns:
        u = hash_unit(key, salt)
        cut_val = test_size + (1.0 - test_size) * val_size
        return df.withColumn(col, F.when(u < test_size, "test").when(u < cut_val, "val").otherwise("train"))
    h = F.md5(F.concat_ws("|", q(key).cast("string"), F.lit(salt)))
    narrow = df.select(q(key).alias("_split_k"), q(label).alias("_split_y"), h.alias("_split_h"))
    split = F.lit("train")
    for r in narrow.groupBy("_split_y").count().collect():
        n_test, n_val = split_sizes(int(r["count"]), test_size, val_size)
        own, pos = F.col("_split_y").eqNullSafe(F.lit(r["_split_y"])), F.col("_split_pos")
        split = F.when(own & (pos <= n_test), "test").when(own & (pos <= n_test + n_val), "val").otherwise(split)
    ranked = rank_within_groups(narrow, "_split_y", [F.col("_split_h"), F.col("_split_k")], "_split_pos")
    return df.join(ranked.select("_split_k", split.alias(col)), q(key) == F.col("_split_k")).drop("_split_k")


# --------------------------------------------------------------------------- fitted statistics
def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Per-column median of non-null values (linear interpolation), all columns together."""
    found = exact_quantiles(df, {c: (q(c), [0.5]) for c in cols})
    return {c: found[c][0] for c in cols}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill nulls with the fitted medians (columns become double)."""
    return df.withColumns({c: F.coalesce(q(c).cast("double"), F.lit(m)) for c, m in medians.items()
                           if m is not None})


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column, whatever the order of the rows; a zero std scales by 1, like the original."""
    return {c: (mean, std or 1.0) for c, (_, mean, std) in exact_moments(df, {c: q(c) for c in cols}).items()}


def standardise(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({c + suffix: (q(c).cast("double") - F.lit(m)) / F.lit(s)
                           for c, (m, s) in stats.items()})


def class_counts(df: DataFrame, label: str = LABEL) -> dict[int, int]:
    return {int(r[0]): int(r[1]) for r in df.groupBy(q(label)).count().collect()}


def balanced_weights(counts: dict[int, int]) -> dict[int, float]:
    """n / (n_classes * n_c) per class."""
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * m) for c, m in counts.items()}


def weight_column(label: str, weights: dict[int, float]) -> Column:
    expr = None
    for c, w in weights.items():
        expr = (F.when(q(label) == c, F.lit(w)) if expr is None else expr.when(q(label) == c, F.lit(w)))
    return expr.otherwise(F.lit(1.0))


# --------------------------------------------------------------------------- model
@dataclass
class ChurnModel:
    """Everything needed to score a row: medians, scaler, coefficients, calibration."""

    features: list[str]
    medians: dict[str, float]
    scaler: dict[str, tuple[float, float]]
    intercept: float
    coefficients: list[float]
    threshold: float = 0.5
    weights: dict[int, float] = field(default_factory=dict)
    iso: IsotonicFit | None = None

    # -- column expressions -------------------------------------------------
    def prepared(self, c: str) -> Column:
        m = self.medians.get(c)
        x = q(c).cast("double")
        return F.coalesce(x, F.lit(m)) if m is not None else x

    def margin(self) -> Column:
        z = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            mean, std = self.scaler[c]
            z = z + F.lit(b) * ((self.prepared(c) - F.lit(mean)) / F.lit(std))
        return z

    def raw_probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def calibrate(self, df: DataFrame, margin: str = "_margin", out: str = "y_proba") -> DataFrame:
        """Add the calibrated probability of the ``margin`` column."""
        if self.iso is None:
            return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(margin))))
        return self.iso.transform(df, margin, out)


def _score_equations(train: DataFrame, features: Sequence[str], label: str, weight: str | None, C: float,
                     beta: np.ndarray, curvature: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Gradient, and on request the Hessian, of C * sum(w * loss) + |b|^2 / 2 at ``beta`` (intercept first): one aggregate."""
    x = [F.lit(1.0), *[q(c).cast("double") for c in features]]
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-sum((F.lit(float(b)) * c for b, c in zip(beta[1:], x[1:])), F.lit(float(beta[0])))))
    w = F.lit(float(C)) * (q(weight) if weight else F.lit(1.0))
    rows = train.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], (w * (p - q(label))).alias("r"), (w * p * (1 - p)).alias("v"))
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i, n)] if curvature else []
    row = rows.agg(*[F.sum(F.col(f"x{i}") * F.col("r")) for i in range(n)],
                   *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("v")) for i, j in pairs]).first()
    penalty = np.array([0.0] + [1.0] * (n - 1))  # the intercept is free
    gradient = np.array([float(v or 0.0) for v in row[:n]]) + penalty * beta
    if not curvature:
        return gradient, None
    hessian = np.zeros((n, n))
    for (i, j), v in zip(pairs, row[n:]):
        hessian[i, j] = hessian[j, i] = float(v or 0.0)
    return gradient, hessian + np.diag(penalty)


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = LABEL,
                 weight: str | None = WEIGHT, C: float = 1.0, max_iter: int = 500,
                 tol: float = 1e-6, optimality: float = 1e-8, newton_steps: int = 20) -> tuple[float, list[float]]:
    """L2-penalised logistic regression with the objective C * sum(w * loss) + |b|^2 / 2.

    MLlib minimises sum(w * loss) / sum(w) + regParam * |b|^2 / 2, so the
    same optimum is reached with regParam = 1 / (C * sum(w)).  The inputs are
    already standardised, hence ``standardization=False``.

    The fit is accepted by the gradient of the stated objective: no component may
    exceed ``optimality * C * sum(w)``.  Where the quasi-Newton search stops short
    of that, Newton steps (one aggregate each) finish it; a fit that still falls
    short raises.
    """
    vec = VectorAssembler(inputCols=list(features), outputCol="_features").transform(train)
    total_w = (vec.agg(F.sum(q(weight))).first()[0] if weight else vec.count())
    lr = LogisticRegression(featuresCol="_features", labelCol=label, regParam=1.0 / (C * total_w),
                            elasticNetParam=0.0, standardization=False, fitIntercept=True,
                            maxIter=max_iter, tol=tol, family="binomial")
    if weight:
        lr = lr.setWeightCol(weight)
    model = lr.fit(vec.select("_features", label, *([weight] if weight else [])))
    beta = np.array([model.intercept, *model.coefficients.toArray()])
    enough = optimality * C * float(total_w)
    gradient, _ = _score_equations(train, features, label, weight, C, beta)
    for _ in range(newton_steps):
        if np.abs(gradient).max() <= enough:
            break
        gradient, hessian = _score_equations(train, features, label, weight, C, beta, curvature=True)
        beta = beta - np.linalg.solve(hessian, gradient)
        gradient, _ = _score_equations(train, features, label, weight, C, beta)
    if not np.abs(gradient).max() <= enough:
        raise ValueError(f"the logistic fit did not converge: a score equation is {np.abs(gradient).max():.3g}, allowed {enough:.3g}")
    return float(beta[0]), [float(b) for b in beta[1:]]


def train_churn_model(model_rows: DataFrame, features: Sequence[str], label: str = LABEL,
                      balance: str = "class_weight", C: float = 1.0, calibrate: bool = True,
                      threshold_rule: str = "f1", split_col: str = SPLIT) -> ChurnModel:
    """Fit on train, calibrate on val, pick the threshold on val calibrated scores.

    ``model_rows`` carries the ``split`` column.  With ``balance='smote'`` the
    caller passes the train rows already oversampled (see ``smote``).
    """
    features = list(features)
    train = model_rows.filter(q(split_col) == "train")
    counts = class_counts(train, label)
    if len(counts) < 2:
        raise ValueError(f"the training split holds a single class {sorted(counts)}; cannot fit a classifier")
    medians = fit_medians(train, features)
    train_i = impute(train, medians)
    if balance == "smote":  # oversample after imputing, before scaling (train rows only)
        from .smote import smote
        train_i = smote(train_i, features, label)
    scaler = fit_scaler(train_i, features)
    scaled = standardise(train_i, scaler)
    weights: dict[int, float] = {}
    if balance == "class_weight":
        weights = balanced_weights(counts)
        scaled = scaled.withColumn(WEIGHT, weight_column(label, weights))
    intercept, coefs = fit_logistic(scaled, features, label, WEIGHT if weights else None, C)
    model = ChurnModel(features, medians, scaler, intercept, coefs, weights=weights)
    val = model_rows.filter(q(split_col) == "val").select(q(label).alias(label),
                                                          model.margin().alias("_margin"))
    if calibrate:
        model.iso = fit_isotonic(val, "_margin", label)
    val_scored = model.calibrate(val, "_margin", "score")
    best = best_threshold(pr_table(val_scored, label, "score"), threshold_rule).first()
    model.threshold = float(best["threshold"]) if best is not None else 0.5
    return model


def score_rows(df: DataFrame, model: ChurnModel, label: str = LABEL, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, y_true, y_proba (calibrated), y_pred and the threshold for every row."""
    base = df.select(*[q(c) for c in keep], q(label).alias("y_true"), model.margin().alias("_margin"))
    scored = model.calibrate(base, "_margin", "y_proba")
    return scored.select(*[q(c) for c in keep], "y_true", "y_proba",
                         (F.col("y_proba") >= F.lit(model.threshold)).cast("int").alias("y_pred"),
                         F.lit(model.threshold).alias("threshold_used"))


def coefficient_table(model: ChurnModel) -> DataFrame:
    """Coefficients per standard deviation and per raw unit, with odds ratios."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = []
    for c, b in zip(model.features, model.coefficients):
        std = model.scaler[c][1]
        per_unit = b / std if std else 0.0
        rows.append((c, b, per_unit))
    df = spark.createDataFrame(rows, "feature STRING, coef_per_sd DOUBLE, coef_per_unit DOUBLE")
    return df.select("*", F.exp("coef_per_sd").alias("odds_ratio_per_sd"),
                     F.exp("coef_per_unit").alias("odds_ratio_per_unit"))


# --------------------------------------------------------------------------- risk index
# Feature column -> (relative change of the churn probability).
RISK_MULTIPLIERS = [
    ("BundleType_core bundle", 0.30),
    ("PMS_Group_EOD pms", 0.15),
    ("Outbound Sms Count Activated", 0.15),
    ("Outbound Call Count Activated", -0.25),
    ("Inbound Sms Count Activated", -0.35),
    ("Inbound Call Count Activated", -0.33),
]


def business_risk_index(df: DataFrame, proba: str = "y_proba") -> Column:
    """Probability scaled by fixed multipliers for present indicator columns, clipped to [0, 1].

    A missing column or null counts as 0.  The two one-hot columns count
    only when equal to 1; the activation flags count by their integer value.
    """
    bri = q(proba)
    for c, k in RISK_MULTIPLIERS:
        if c not in df.columns:
            continue
        v = F.coalesce(q(c), F.lit(0))
        v = (v == 1).cast("int") if c.startswith(("BundleType_", "PMS_Group_")) else v.cast("int")
        bri = bri * (F.lit(1.0) + F.lit(k) * v)
    return F.greatest(F.least(bri, F.lit(1.0)), F.lit(0.0))


# --------------------------------------------------------------------------- persistence
def save_model(model: ChurnModel, path: str) -> None:
    """Parameters as one JSON row (parquet) plus the calibration table, under ``path``."""
    import json
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    params = {"features": model.features, "medians": model.medians,
              "scaler": {k: list(v) for k, v in model.scaler.items()}, "intercept": model.intercept,
              "coefficients": model.coefficients, "threshold": model.threshold,
              "calibrated": model.iso is not None,
              "weights": {str(k): v for k, v in model.weights.items()}}
    spark.createDataFrame([(json.dumps(params),)], "params STRING").write.parquet(f"{path}/params")
    if model.iso is not None:
        model.iso.save(f"{path}/isotonic")


def load_model(path: str) -> ChurnModel:
    import json
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    p = json.loads(spark.read.parquet(f"{path}/params").first()["params"])
    m = ChurnModel(p["features"], p["medians"], {k: tuple(v) for k, v in p["scaler"].items()},
                   p["intercept"], p["coefficients"], threshold=p["threshold"],
                   weights={int(k): v for k, v in p["weights"].items()})
    if p["calibrated"]:
        m.iso = IsotonicFit.load(f"{path}/isotonic")
    return m
