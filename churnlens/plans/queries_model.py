"""Stage-2 queries: features, split, fitted statistics, scoring, evaluation, risk, inference."""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.columns import COLUMN_ALIASES, DROP_COLUMNS, USAGE_TAG, ColumnPlan, standardise_columns
from ..operators import evaluation as EV
from ..operators import features as FE
from ..operators import inference as INF
from ..operators import modeling as MO
from ..operators.cleaning import q
from ..operators.exact_sums import exact_sums
from ..operators.ranking import global_rank
from ..sources.testdata import read_table
from .oracle_cohort import stage1
from .oracle_model import FEATURE_SQL, coefficient_score_sql, risk_sql, stage2
from .queries_cohort import cohort_frame
from .stages import materialised, remembered
from .registry import TESTDATA_PARAMS, register

LO, HI = TESTDATA_PARAMS["churn_range"]
FEATS = FE.MODEL_FEATURES
ACTIVATED = [f"{c} Activated" for c in FE.USAGE_COLUMNS]
REASON_FLAGS = [f"{c} Flag" for c in FE.REASON_COLUMNS]


# --------------------------------------------------------------------- pipeline pieces
def enriched_and_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Enriched rows (written once) and model rows (one-hot + label expressions over them;
    the model rows keep the one-hot source columns for reports)."""
    def build_enriched():
        std = standardise_columns(cohort_frame(spark, sf_dir))
        enriched, _ = FE.engineer_features(std, churn_range=(LO, HI), with_model=False)
        return enriched
    enriched = materialised(spark, sf_dir, "enriched", build_enriched)
    model = materialised(spark, sf_dir, "model", lambda: FE.model_frame(enriched, keep_source=True),
                         write=False)
    return enriched, model


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, the 13 features (double), extra flags, label, split and report columns.

    Written once per session and folder: the stratified split ranks rows
    within each class, and every later stage reads the same assignment.
    """
    def build():
        _, model = enriched_and_model(spark, sf_dir)
        feats = FE.available_features(model)
        extra = [c for c in ACTIVATED if c not in feats and c in model.columns]
        ids = ColumnPlan(model).present(FE.ID_CANDIDATES)[:1]  # first present id column
        out = model.select(
            FE.ROW_ID, *[q(c) for c in ids],
            *[X.finite_or_null(q(f)).alias(f) for f in feats], *[q(c) for c in extra],
            F.col(FE.LABEL), q("Core Industry"), q("BundleType"), q(FE.TENURE).cast("double").alias("tenure"),
            q("Lifetime Value").cast("double").alias("revenue"), q("Starting Mrr").cast("double").alias("starting_mrr"))
        return MO.stratified_split(out, FE.ROW_ID)
    return materialised(spark, sf_dir, "model_rows", build)


def coef_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows scored with the published coefficient table, plus the risk index."""
    m = model_rows(spark, sf_dir)
    s = m.withColumn("p_churn", INF.coefficient_probability(INF.PUBLISHED_COEFFICIENTS))
    return s.withColumn("business_risk_index", MO.business_risk_index(s, "p_churn"))


def with_ranks(scored: DataFrame, proba: str) -> DataFrame:
    """Ranks by probability and by risk index: narrow rows are ranked, then joined back by row id."""
    narrow = scored.select(FE.ROW_ID, proba, "business_risk_index")
    ranks = global_rank(narrow, [F.col(proba).desc(), F.col(FE.ROW_ID)], "rank_by_p")
    ranks = global_rank(ranks, [F.col("business_risk_index").desc(), F.col(FE.ROW_ID)], "rank_by_bri")
    return scored.join(ranks.select(FE.ROW_ID, "rank_by_p", "rank_by_bri"), FE.ROW_ID)


def _r(c, d: int = 9):
    return F.round(c, d)


def _rs(expr: str, d: int = 9) -> str:
    return f"round({expr}, {d})"


# --------------------------------------------------------------------- standardise + features
_STD_PICK = ["Slug", "Finance Id", "Location Id", "Churn or Retain", "lifetime in Month",
             "Week 1 Cases", "Inbound Sms Count", "Manual Messages Sms Count", "Reason Billing"]
_STD_SRC = ["SLUG", "FINANCE_ID", "LOCATION_ID", "CHURN_OR_RETAIN", "LIFETIME_MONTHS",
            "WEEK_1_CASES", "FIRST_INBOUND_SMS_COUNT", "FIRST_MISSED_TEXT_SMS_COUNT", "REASON_BILLING"]


@register("standardise_columns", stage2("SELECT " + ", ".join(
    f'{s} AS "{t}"' for s, t in zip(_STD_SRC, _STD_PICK)) + " FROM clean"))
def q_standardise_columns(spark, sf_dir):
    std = standardise_columns(cohort_frame(spark, sf_dir))
    return std.select(*[q(c) for c in _STD_PICK])


@register("tagged_columns", """
SELECT c_custkey AS "Finance Id", c_name AS "Location Name", CAST(c_acctbal AS DOUBLE) AS "Inbound Sms Count", c_mktsegment AS filters,
       CAST(11 AS INTEGER) AS n_dropped, CAST(34 AS INTEGER) AS n_absent
FROM customer""")
def q_tagged_columns(spark, sf_dir):
    """An export with alias names, a tagged name and every unwanted column: names settled, the eleven gone, the absent counted."""
    c = read_table(spark, sf_dir, "customer")
    raw = c.select(F.col("c_custkey").alias("FINANCE_ID"), F.col("c_name").alias("LOCATION_NAME"),
                   F.col("c_acctbal").cast("double").alias(f"Inbound  Sms {USAGE_TAG} Count"), F.col("c_mktsegment").alias("filters"),
                   *[F.col("c_nationkey").alias(n) for n in DROP_COLUMNS])
    plan = ColumnPlan(raw, COLUMN_ALIASES, USAGE_TAG, DROP_COLUMNS)
    gone = len(raw.columns) - len(plan.renames())
    return plan.apply(raw).select("*", F.lit(gone).alias("n_dropped"), F.lit(len(plan.absent())).alias("n_absent"))


@register("feature_rows", stage2("""
SELECT row_id, CHURN_OR_RETAIN AS "Churn or Retain", LIFETIME_MONTHS AS "lifetime in Month",
       bundle_type AS "BundleType", pms_group AS "PMS_Group",
       first_month_swat_cases AS "First Month SWAT Cases"
FROM enr"""))
def q_feature_rows(spark, sf_dir):
    enr, _ = enriched_and_model(spark, sf_dir)
    return enr.select(FE.ROW_ID, q("Churn or Retain"), q("lifetime in Month"), q("BundleType"),
                      q("PMS_Group"), q("First Month SWAT Cases"))


@register("activation_flags", stage2(
    "SELECT row_id, " + ", ".join(f'{FEATURE_SQL[c]} AS "{c}"' for c in ACTIVATED) + " FROM enr"))
def q_activation_flags(spark, sf_dir):
    enr, _ = enriched_and_model(spark, sf_dir)
    return enr.select(FE.ROW_ID, *[q(c) for c in ACTIVATED])


@register("reason_flags", stage2(
    "SELECT row_id, " + ", ".join(f'{FEATURE_SQL[c]} AS "{c}"' for c in REASON_FLAGS) + " FROM enr"))
def q_reason_flags(spark, sf_dir):
    enr, _ = enriched_and_model(spark, sf_dir)
    return enr.select(FE.ROW_ID, *[q(c) for c in REASON_FLAGS])


@register("feature_vector", stage2(
    "SELECT row_id, " + ", ".join(f'"{f}"' for f in FEATS) + ", churn_flag FROM mdl"))
def q_feature_vector(spark, sf_dir):
    return model_rows(spark, sf_dir).select(FE.ROW_ID, *[q(f) for f in FEATS], FE.LABEL)


# --------------------------------------------------------------------- split and fitted statistics
@register("stratified_split", stage2("SELECT row_id, churn_flag, split FROM mdl"))
def q_stratified_split(spark, sf_dir):
    return model_rows(spark, sf_dir).select(FE.ROW_ID, FE.LABEL, "split")


@register("class_balance", stage2("""
SELECT split, churn_flag AS label, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 3) AS share
FROM mdl GROUP BY split, churn_flag"""))
def q_class_balance(spark, sf_dir):
    return EV.class_balance(model_rows(spark, sf_dir), "split", FE.LABEL)


@register("nonnull_by_label", stage2(
    "SELECT churn_flag, " + ", ".join(f'count("{f}") AS "{f}"' for f in FEATS)
    + " FROM mdl GROUP BY churn_flag"))
def q_nonnull_by_label(spark, sf_dir):
    m = model_rows(spark, sf_dir)
    return m.groupBy(FE.LABEL).agg(*[F.count(q(f)).alias(f) for f in FEATS])


def _per_feature_sql(expr: str, alias: str, where: str = "split = 'train'") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, {expr.format(c=chr(34) + f + chr(34))} AS {alias} FROM mdl WHERE {where}"
        for f in FEATS)


@register("median_impute", stage2(_per_feature_sql("CAST(median({c}) AS DOUBLE)", "median")))
def q_median_impute(spark, sf_dir):
    m = model_rows(spark, sf_dir).filter(F.col("split") == "train")
    med = MO.fit_medians(m, FEATS)
    return spark.createDataFrame([(f, med[f]) for f in FEATS], "feature STRING, median DOUBLE")


@register("standardise", stage2("\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, round(avg(\"{f}\"), 9) AS mean, "
    f"round(CASE WHEN stddev_pop(\"{f}\") > 0 THEN stddev_pop(\"{f}\") ELSE 1.0 END, 9) AS std "
    f"FROM mdl WHERE split = 'train'" for f in FEATS)))
def q_standardise(spark, sf_dir):
    m = model_rows(spark, sf_dir).filter(F.col("split") == "train")
    st = MO.fit_scaler(m, FEATS)
    df = spark.createDataFrame([(f, *st[f]) for f in FEATS], "feature STRING, mean DOUBLE, std DOUBLE")
    return df.select("feature", _r("mean").alias("mean"), _r("std").alias("std"))


@register("balanced_weights", stage2("""
SELECT churn_flag, count(*) AS n, round(sum(count(*)) OVER () / (2.0 * count(*)), 9) AS weight
FROM mdl WHERE split = 'train' GROUP BY churn_flag"""))
def q_balanced_weights(spark, sf_dir):
    m = model_rows(spark, sf_dir).filter(F.col("split") == "train")
    counts = MO.class_counts(m)
    w = MO.balanced_weights(counts)
    return spark.createDataFrame([(k, counts[k], round(w[k], 9)) for k in sorted(counts)],
                                 "churn_flag INT, n LONG, weight DOUBLE")


# --------------------------------------------------------------------- published-coefficient scores
P_SQL = coefficient_score_sql(INF.PUBLISHED_COEFFICIENTS)
SCORED_CTE = f"""
sc AS (
  SELECT *, {P_SQL} AS p_churn FROM mdl
),
scr AS (
  SELECT *, {risk_sql('p_churn')} AS business_risk_index FROM sc
)"""


def stage2s(body: str, *extra: str) -> str:
    return stage2(body, SCORED_CTE, *extra)


@register("coefficient_scores", stage2s(f"""
SELECT row_id, split, churn_flag AS y_true, {_rs('p_churn')} AS p_churn,
       {_rs('business_risk_index')} AS business_risk_index FROM scr"""))
def q_coefficient_scores(spark, sf_dir):
    s = coef_scored(spark, sf_dir)
    return s.select(FE.ROW_ID, "split", F.col(FE.LABEL).alias("y_true"), _r("p_churn").alias("p_churn"),
                    _r("business_risk_index").alias("business_risk_index"))


PR_CTE = """
g AS (
  SELECT p_churn AS threshold, sum(churn_flag) AS pos, sum(1 - churn_flag) AS neg
  FROM scr WHERE split = 'val' GROUP BY p_churn
),
cum AS (
  SELECT threshold, pos, neg,
         sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
         sum(pos) OVER () AS total_pos
  FROM g
),
pr AS (
  SELECT *, tp / (tp + fp) AS precision,
         CASE WHEN total_pos > 0 THEN tp / total_pos ELSE 1.0 END AS recall
  FROM cum
),
prf AS (
  SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM pr
),
best AS (
  SELECT threshold FROM prf ORDER BY f1 DESC, threshold ASC LIMIT 1
),
tst AS (
  SELECT churn_flag AS y, p_churn AS p, CAST(p_churn >= (SELECT threshold FROM best) AS INTEGER) AS yhat
  FROM scr WHERE split = 'test'
)"""


def _val_pr(spark, sf_dir) -> DataFrame:
    s = coef_scored(spark, sf_dir).filter(F.col("split") == "val")
    return EV.pr_table(s, FE.LABEL, "p_churn")


def _test_pred(spark, sf_dir) -> DataFrame:
    s = coef_scored(spark, sf_dir)
    pr = EV.pr_table(s.filter(F.col("split") == "val"), FE.LABEL, "p_churn")
    thr = EV.best_threshold(pr).first()["threshold"]
    return s.filter(F.col("split") == "test").select(
        F.col(FE.LABEL).alias("y"), F.col("p_churn").alias("p"),
        (F.col("p_churn") >= F.lit(thr)).cast("int").alias("yhat"))


@register("pr_curve", stage2s(f"""
SELECT {_rs('threshold')} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       {_rs('precision')} AS precision, {_rs('recall')} AS recall, {_rs('f1')} AS f1
FROM prf""", PR_CTE))
def q_pr_curve(spark, sf_dir):
    pr = _val_pr(spark, sf_dir)
    return pr.select(_r("threshold").alias("threshold"), F.col("tp").cast("long").alias("tp"),
                     F.col("fp").cast("long").alias("fp"), _r("precision").alias("precision"),
                     _r("recall").alias("recall"), _r("f1").alias("f1"))


@register("best_threshold", stage2s(f"""
SELECT {_rs('threshold')} AS threshold, {_rs('precision')} AS precision, {_rs('recall')} AS recall,
       {_rs('f1')} AS f1
FROM prf ORDER BY f1 DESC, threshold ASC LIMIT 1""", PR_CTE))
def q_best_threshold(spark, sf_dir):
    b = EV.best_threshold(_val_pr(spark, sf_dir))
    return b.select(_r("threshold").alias("threshold"), _r("precision").alias("precision"),
                    _r("recall").alias("recall"), _r("f1").alias("f1"))


def _safe(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


@register("binary_metrics", stage2s(f"""
SELECT {_rs(_safe('tp + tn', 'tp + tn + fp + fn'))} AS accuracy, {_rs(_safe('tp', 'tp + fp'))} AS precision,
       {_rs(_safe('tp', 'tp + fn'))} AS recall, {_rs(_safe('2.0 * tp', '2 * tp + fp + fn'))} AS f1
FROM (SELECT count_if(y = 1 AND yhat = 1) AS tp, count_if(y = 0 AND yhat = 1) AS fp,
             count_if(y = 1 AND yhat = 0) AS fn, count_if(y = 0 AND yhat = 0) AS tn FROM tst) c""", PR_CTE))
def q_binary_metrics(spark, sf_dir):
    m = EV.binary_metrics(_test_pred(spark, sf_dir), "y", "yhat")
    return m.select(*[_r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("confusion_matrix", stage2s("""
SELECT t.y_true, t.y_pred, count(tst.y) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(y_true, y_pred)
LEFT JOIN tst ON tst.y = t.y_true AND tst.yhat = t.y_pred
GROUP BY t.y_true, t.y_pred""", PR_CTE))
def q_confusion_matrix(spark, sf_dir):
    return EV.confusion_matrix(_test_pred(spark, sf_dir), "y", "yhat")


CLS_CTE = """
c AS (SELECT count_if(y = 1 AND yhat = 1) AS tp, count_if(y = 0 AND yhat = 1) AS fp,
             count_if(y = 1 AND yhat = 0) AS fn, count_if(y = 0 AND yhat = 0) AS tn FROM tst),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
             CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0,
             CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
             tp + fp + fn + tn AS total FROM c),
f AS (SELECT *, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1,
             CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0 FROM m)"""


@register("classification_report", stage2s("""
SELECT '0' AS class, round(p0, 4) AS precision, round(r0, 4) AS recall, round(f0, 4) AS f1_score,
       CAST(tn + fp AS BIGINT) AS support FROM f
UNION ALL SELECT '1', round(p1, 4), round(r1, 4), round(f1, 4), CAST(tp + fn AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(CASE WHEN total > 0 THEN (tp + tn) / total ELSE 0.0 END, 4),
       CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4),
       CAST(total AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg',
       round(CASE WHEN total > 0 THEN (p0 * (tn + fp) + p1 * (tp + fn)) / total ELSE 0.0 END, 4),
       round(CASE WHEN total > 0 THEN (r0 * (tn + fp) + r1 * (tp + fn)) / total ELSE 0.0 END, 4),
       round(CASE WHEN total > 0 THEN (f0 * (tn + fp) + f1 * (tp + fn)) / total ELSE 0.0 END, 4),
       CAST(total AS BIGINT) FROM f""", PR_CTE, CLS_CTE))
def q_classification_report(spark, sf_dir):
    return EV.classification_report(_test_pred(spark, sf_dir), "y", "yhat")


ROC_CTE = """
tg AS (SELECT p AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM tst GROUP BY p),
tc AS (SELECT *, sum(neg) OVER (ORDER BY threshold DESC) AS fp_cum,
              sum(pos) OVER (ORDER BY threshold DESC) AS tp_cum,
              sum(pos) OVER () AS tot_pos, sum(neg) OVER () AS tot_neg FROM tg)"""


@register("roc_auc", stage2s(f"""
SELECT {_rs('sum(pos * ((tot_neg - fp_cum) + 0.5 * neg)) / (max(tot_pos) * max(tot_neg))')} AS roc_auc
FROM tc""", PR_CTE, ROC_CTE))
def q_roc_auc(spark, sf_dir):
    t = _test_pred(spark, sf_dir)
    s = EV.curve_summary(EV.pr_table(t, "y", "p"))
    return s.select(_r("roc_auc").alias("roc_auc"))


@register("average_precision", stage2s(f"""
SELECT {_rs('sum(pos * tp_cum / (tp_cum + fp_cum)) / max(tot_pos)')} AS average_precision
FROM tc""", PR_CTE, ROC_CTE))
def q_average_precision(spark, sf_dir):
    t = _test_pred(spark, sf_dir)
    s = EV.curve_summary(EV.pr_table(t, "y", "p"))
    return s.select(_r("average_precision").alias("average_precision"))


@register("probability_summary", stage2s("""
SELECT CAST(count(p_churn) AS DOUBLE) AS count, round(avg(p_churn), 4) AS mean,
       round(stddev_samp(p_churn), 4) AS std, round(min(p_churn), 4) AS min,
       round(quantile_cont(p_churn, 0.1), 4) AS p10, round(quantile_cont(p_churn, 0.5), 4) AS p50,
       round(quantile_cont(p_churn, 0.9), 4) AS p90, round(max(p_churn), 4) AS max
FROM scr"""))
def q_probability_summary(spark, sf_dir):
    return EV.probability_summary(coef_scored(spark, sf_dir), "p_churn")


# --------------------------------------------------------------------- risk ranking and risk page
@register("risk_ranks", stage2s("""
SELECT row_id, row_number() OVER (ORDER BY p_churn DESC, row_id) AS rank_by_p,
       row_number() OVER (ORDER BY business_risk_index DESC, row_id) AS rank_by_bri
FROM scr"""))
def q_risk_ranks(spark, sf_dir):
    s = coef_scored(spark, sf_dir).select(FE.ROW_ID, "p_churn", "business_risk_index")
    return with_ranks(s, "p_churn").select(FE.ROW_ID, "rank_by_p", "rank_by_bri")


@register("risk_ranked_accounts", stage2s(f"""
SELECT row_id, "Core Industry", "BundleType", churn_flag AS y_true, {_rs('p_churn')} AS p_churn,
       {_rs('business_risk_index')} AS business_risk_index,
       row_number() OVER (ORDER BY p_churn DESC, row_id) AS rank_by_p,
       row_number() OVER (ORDER BY business_risk_index DESC, row_id) AS rank_by_bri
FROM scr"""))
def q_risk_ranked_accounts(spark, sf_dir):
    """Flagship: every account's churn probability, risk index and both ranks (skew-safe global rank)."""
    s = with_ranks(coef_scored(spark, sf_dir), "p_churn")
    return s.select(FE.ROW_ID, q("Core Industry"), q("BundleType"), F.col(FE.LABEL).alias("y_true"),
                    _r("p_churn").alias("p_churn"), _r("business_risk_index").alias("business_risk_index"),
                    "rank_by_p", "rank_by_bri")


@register("risk_quantile", stage2s(
    f"SELECT {_rs('quantile_cont(business_risk_index, 0.8)')} AS high_risk_threshold FROM scr"))
def q_risk_quantile(spark, sf_dir):
    from ..operators import reports as RP
    thr = RP.risk_threshold(coef_scored(spark, sf_dir), "business_risk_index", 0.8)
    return spark.createDataFrame([(thr,)], "high_risk_threshold DOUBLE").select(
        _r("high_risk_threshold").alias("high_risk_threshold"))


@register("high_risk_top20", stage2s(f"""
SELECT row_id, "Core Industry", "BundleType", {_rs('p_churn')} AS p_churn,
       {_rs('business_risk_index')} AS business_risk_index
FROM scr WHERE business_risk_index >= (SELECT quantile_cont(business_risk_index, 0.8) FROM scr)
ORDER BY business_risk_index DESC, row_id LIMIT 20"""))
def q_high_risk_top20(spark, sf_dir):
    from ..operators import reports as RP
    s = coef_scored(spark, sf_dir)
    top = RP.high_risk_top(s, "business_risk_index", FE.ROW_ID, 0.8, 20)
    return top.select(FE.ROW_ID, q("Core Industry"), q("BundleType"), _r("p_churn").alias("p_churn"),
                      _r("business_risk_index").alias("business_risk_index"))


@register("risk_histogram", stage2s("""
SELECT CAST(least(floor(business_risk_index * 50), 49) AS INTEGER) AS bin,
       CAST(least(floor(business_risk_index * 50), 49) AS DOUBLE) / 50 AS bin_start, count(*) AS n
FROM scr GROUP BY 1, 2"""))
def q_risk_histogram(spark, sf_dir):
    from ..operators import reports as RP
    return RP.fixed_histogram(coef_scored(spark, sf_dir), "business_risk_index", 50, 0.0, 1.0)


def _group_sql(col: str, risk: bool) -> str:
    r = ", round(avg(business_risk_index), 3) AS Avg_Risk_Index" if risk else ""
    return f"""
SELECT "{col}", count(churn_flag) AS Total_Customers, CAST(sum(churn_flag) AS BIGINT) AS Churned_Customers,
       round(avg(churn_flag), 3) AS Churn_Rate, round(avg(p_churn), 3) AS Avg_Churn_Prob{r}
FROM scr WHERE "{col}" IS NOT NULL GROUP BY "{col}\""""


@register("churn_by_industry", stage2s(_group_sql("Core Industry", True)))
def q_churn_by_industry(spark, sf_dir):
    from ..operators import reports as RP
    return RP.churn_by_group(coef_scored(spark, sf_dir), "Core Industry", FE.LABEL)


@register("churn_by_bundle", stage2s(_group_sql("BundleType", False)))
def q_churn_by_bundle(spark, sf_dir):
    from ..operators import reports as RP
    return RP.churn_by_group(coef_scored(spark, sf_dir), "BundleType", FE.LABEL, risk=None)


@register("confusion_revenue", stage2s("""
SELECT y, yhat, round(sum(starting_mrr), 2) AS starting_mrr, count(*) AS n
FROM (SELECT churn_flag AS y, CAST(p_churn >= (SELECT threshold FROM best) AS INTEGER) AS yhat, starting_mrr FROM scr) t
GROUP BY y, yhat""", PR_CTE))
def q_confusion_revenue(spark, sf_dir):
    """Starting revenue by actual and predicted label, with the threshold tuned on the validation rows."""
    s = coef_scored(spark, sf_dir)
    thr = EV.best_threshold(_val_pr(spark, sf_dir)).first()["threshold"]
    return (s.select(F.col(FE.LABEL).alias("y"), (F.col("p_churn") >= F.lit(thr)).cast("int").alias("yhat"), "starting_mrr")
            .transform(lambda rows: exact_sums(rows, {"starting_mrr": F.col("starting_mrr")}, [F.col("y"), F.col("yhat")], n=F.count(F.lit(1))))
            .withColumn("starting_mrr", F.round("starting_mrr", 2)))


# --------------------------------------------------------------------- fitted model (invariant checks)
def fitted(spark, sf_dir):
    """Model rows, features and the fitted model (fitted once per session and folder)."""
    def build():
        m = model_rows(spark, sf_dir)
        feats = FE.available_features(m)
        return m, feats, MO.train_churn_model(m, feats)
    return remembered(spark, sf_dir, "churn_model", build)


@register("balanced_logit_optimality", stage2(
    "SELECT count(*) AS n_train, CAST(0.0 AS DOUBLE) AS max_abs_gradient FROM mdl WHERE split = 'train'"))
def q_balanced_logit_optimality(spark, sf_dir):
    """Max |gradient| of the balanced, L2 (C = 1) objective at the MLlib solution.

    Computed as one distributed aggregate over the training rows; it is 0
    (to 1e-4) exactly when the fit is the optimum of the original objective.
    """
    m, feats, model = fitted(spark, sf_dir)
    train = m.filter(F.col("split") == "train")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin()))
    w = MO.weight_column(FE.LABEL, model.weights)
    r = w * (p - F.col(FE.LABEL))
    grads = [F.sum(r).alias("g_const")]
    for c, b in zip(feats, model.coefficients):
        mean, std = model.scaler[c]
        grads.append((F.sum(r * ((model.prepared(c) - F.lit(mean)) / F.lit(std))) + F.lit(b)).alias(f"g{len(grads)}"))
    g = train.agg(*grads)
    mx = F.greatest(*[F.abs(F.col(c)) for c in g.columns])
    n = train.count()
    return g.select(F.lit(n).cast("long").alias("n_train"),
                    F.when(mx < 1e-4, F.lit(0.0)).otherwise(mx).alias("max_abs_gradient"))


def with_enriched(spark, sf_dir, scored: DataFrame) -> DataFrame:
    """Scores joined to every enriched column, as the original writes them: the id column comes first.

    Score columns that an enriched column shares a name with win.
    """
    enriched, _ = enriched_and_model(spark, sf_dir)
    ids = ColumnPlan(enriched).present(FE.ID_CANDIDATES)[:1]
    taken = {FE.ROW_ID, *scored.columns, *ids}
    rest = [c for c in enriched.columns if c not in taken]
    out = scored.join(enriched.select(FE.ROW_ID, *[q(c) for c in [*ids, *rest]]), FE.ROW_ID)
    return out.select(*[q(c) for c in [*ids, FE.ROW_ID, *rest]], *[q(c) for c in scored.columns if c != FE.ROW_ID])


@register("scored_rows_all_splits")
def q_scored_rows_all_splits(spark, sf_dir):
    """Rows of all splits: id, every enriched column, split, true label, calibrated score, label, threshold."""
    m, feats, model = fitted(spark, sf_dir)
    s = MO.score_rows(m, model, FE.LABEL, keep=[FE.ROW_ID, "split"])
    return with_enriched(spark, sf_dir, s.withColumnsRenamed(
        {"y_true": "model_y_true", "y_proba": "pred_proba", "y_pred": "pred_label"}))


@register("scored_dataset_with_risk")
def q_scored_dataset_with_risk(spark, sf_dir):
    """Every row (split = 'all') with id, all enriched columns, calibrated probability, risk index and both ranks."""
    m, feats, model = fitted(spark, sf_dir)
    s = MO.score_rows(m, model, FE.LABEL, keep=[FE.ROW_ID, *feats])
    s = s.withColumn("business_risk_index", MO.business_risk_index(s, "y_proba"))
    s = with_ranks(s, "y_proba").select(
        FE.ROW_ID, F.lit("all").alias("split"), "y_true", "y_proba", "y_pred", "threshold_used",
        F.col("y_proba").alias("p_churn"), "business_risk_index", "rank_by_p", "rank_by_bri")
    return with_enriched(spark, sf_dir, s)  # ``rank_by_bri`` is the order of the risk table; sorting wide rows is left to its writer


@register("risk_order", stage2s(f"""
SELECT row_id, CAST(row_number() OVER (ORDER BY business_risk_index DESC, row_id) AS BIGINT) AS position,
       round(business_risk_index, 9) AS business_risk_index FROM scr"""))
def q_risk_order(spark, sf_dir):
    """The place of every row in the risk table, most at risk first."""
    s = with_ranks(coef_scored(spark, sf_dir), "p_churn")
    return s.select(FE.ROW_ID, F.col("rank_by_bri").alias("position"), _r("business_risk_index").alias("business_risk_index"))


_SCORED_ID = [("Location Id", "LOCATION_ID"), ("Slug", "SLUG"), ("Starting Mrr", "STARTING_MRR"), ("Lifetime Value", "LIFETIME_VALUE"),
              ("lifetime in Month", "LIFETIME_MONTHS"), ("Churn or Retain", "CHURN_OR_RETAIN"), ("Starting Bundle", "STARTING_BUNDLE"),
              ("Week 1 Cases", "WEEK_1_CASES"), ("Integrations", "INTEGRATIONS")]


@register("scored_rows_enriched", stage2s(
    "SELECT e.row_id, " + ", ".join(f'e.{c} AS "{n}"' for n, c in _SCORED_ID) + ", e.bundle_type AS \"BundleType\", "
    "m.split, m.churn_flag AS model_y_true FROM enr e JOIN mdl m ON e.row_id = m.row_id"))
def q_scored_rows_enriched(spark, sf_dir):
    """The scored rows of all splits, on everything but the fitted numbers."""
    s = q_scored_rows_all_splits(spark, sf_dir)
    return s.select(FE.ROW_ID, *[q(n) for n, _ in _SCORED_ID], "BundleType", "split", "model_y_true")


@register("scored_rows_consistency", stage2s(
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS bad_proba, CAST(0 AS BIGINT) AS bad_pred, CAST(0 AS BIGINT) AS bad_risk, "
    "CAST(0 AS BIGINT) AS bad_rank FROM scr"))
def q_scored_rows_consistency(spark, sf_dir):
    """The fitted numbers against a second way to them.

    Probabilities: MLlib's isotonic regression over the margin, itself
    recomputed from the coefficients and the raw features.  Labels: the stored
    probability against the F1-optimal threshold of the recomputed validation
    scores.  Risk: the factors applied one by one.  Ranks: a permutation whose
    equal probabilities stand together.
    """
    m, feats, model = fitted(spark, sf_dir)
    z = F.lit(model.intercept)
    for c, b in zip(feats, model.coefficients):
        mean, std = model.scaler[c]
        z = z + (F.coalesce(q(c).cast("double"), F.lit(model.medians[c])) - mean) * (b / std)
    own = m.withColumn("z", z)
    val = own.filter(F.col("split") == "val").select("z", F.col(FE.LABEL).cast("double").alias("y"))
    other = IsotonicRegression(featuresCol="z", labelCol="y", predictionCol="p").fit(val)
    own = other.transform(own)
    cut = EV.best_threshold(EV.pr_table(own.filter(F.col("split") == "val").select(FE.LABEL, "p"), FE.LABEL, "p")).first()["threshold"]
    risk = F.col("p")
    for c, k in MO.RISK_MULTIPLIERS:
        if c in own.columns:
            risk = F.when(q(c).cast("int") == 1, risk * (1 + k)).otherwise(risk)
    own = own.select(F.col(FE.ROW_ID).alias("_id"), "p", F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0)).alias("risk"))
    s = q_scored_dataset_with_risk(spark, sf_dir).select(FE.ROW_ID, "y_proba", "y_pred", "business_risk_index", "rank_by_p", "rank_by_bri")
    j = s.join(own, F.col(FE.ROW_ID) == F.col("_id"))
    order = j.groupBy("y_proba").agg(F.count(F.lit(1)).alias("n"), F.min("rank_by_p").alias("lo"), F.max("rank_by_p").alias("hi"))
    gaps = order.filter(F.col("hi") - F.col("lo") + 1 != F.col("n")).count()
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.col("p") - F.col("y_proba")) > 1e-9).alias("bad_proba"),
                 F.count_if(F.col("y_pred") != (F.col("y_proba") >= F.lit(cut) - 1e-12).cast("int")).alias("bad_pred"),
                 F.count_if(F.abs(F.col("risk") - F.col("business_risk_index")) > 1e-9).alias("bad_risk"),
                 (F.lit(gaps) + F.count(F.lit(1)) * 2 - F.count_distinct("rank_by_p") - F.count_distinct("rank_by_bri")).alias("bad_rank"))


# --------------------------------------------------------------------- inference (GLR)
_ONE = "Outbound Call Count Activated"


ONE_CTE = f"""
cells AS (
  SELECT count_if("{_ONE}" = 0 AND churn_flag = 0) AS a, count_if("{_ONE}" = 0 AND churn_flag = 1) AS b,
         count_if("{_ONE}" = 1 AND churn_flag = 0) AS c, count_if("{_ONE}" = 1 AND churn_flag = 1) AS d
  FROM mdl)"""


@register("logit_one_flag", stage2(f"""
SELECT 'const' AS variable, round(ln(b / a), 6) AS coefficient, round(sqrt(1.0 / a + 1.0 / b), 6) AS std_err
FROM cells
UNION ALL
SELECT '{_ONE}', round(ln((a * d) / (b * c)), 6), round(sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d), 6)
FROM cells""", ONE_CTE))
def q_logit_one_flag(spark, sf_dir):
    """Closed-form check of the GLR table: one binary feature, log odds ratio and its SE."""
    m = model_rows(spark, sf_dir)
    t = INF.logit_inference(m, [_ONE], FE.LABEL, impute_median=False)
    return t.select("variable", F.round("coefficient", 6).alias("coefficient"),
                    F.round("std_err", 6).alias("std_err"))


def _attr_sql() -> str:
    coefs = INF.PUBLISHED_COEFFICIENTS
    feats = [f for f in FEATS if f in coefs]
    means = ", ".join(f'avg("{f}") AS "m_{f}"' for f in feats)
    phis = ", ".join(f'{_rs(f"({coefs[f]!r}) * (v.\"{f}\" - bg.\"m_{f}\")")} AS "phi_{f}"' for f in feats)
    base = " + ".join([repr(coefs["const"])] + [f'({coefs[f]!r}) * bg."m_{f}"' for f in feats])
    margin = " + ".join([repr(coefs["const"])] + [f'({coefs[f]!r}) * v."{f}"' for f in feats])
    return stage2(f"""
SELECT v.row_id, {phis}, {_rs(base)} AS base_value, {_rs(margin)} AS margin
FROM mdl v, (SELECT {means} FROM mdl WHERE split = 'train') bg
WHERE v.split = 'val'""")


@register("linear_attributions", _attr_sql())
def q_linear_attributions(spark, sf_dir):
    """Per-row contributions of each feature to the published model's margin (val rows)."""
    m = model_rows(spark, sf_dir)
    feats = [f for f in FE.available_features(m) if f in INF.PUBLISHED_COEFFICIENTS]
    means = INF.background_means(m.filter(F.col("split") == "train"), feats)
    val = m.filter(F.col("split") == "val")
    out = INF.linear_attributions(val, INF.PUBLISHED_COEFFICIENTS, means, keep=[FE.ROW_ID])
    return out.select(FE.ROW_ID, *[_r(c).alias(c) for c in out.columns if c != FE.ROW_ID])


@register("model_attributions", stage2(
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS off_margin, CAST(0 AS BIGINT) AS off_mean FROM mdl WHERE split = 'val'"))
def q_model_attributions(spark, sf_dir):
    """Contributions to the fitted model's margin on the validation rows: they add up to the margin of every row, and to nothing
    over the training rows."""
    m, feats, model = fitted(spark, sf_dir)
    train, val = m.filter(F.col("split") == "train"), m.filter(F.col("split") == "val")
    phis = [q(f"phi_{c}") for c in feats]
    gap = sum(phis, F.col("base_value")) - F.col("margin")
    out = INF.model_attributions(val, model, train, keep=[FE.ROW_ID])
    mean = INF.model_attributions(train, model, train).agg(F.greatest(*[F.abs(F.avg(p)) for p in phis], F.abs(F.avg("margin") - F.first("base_value")))).first()[0]
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(gap) > 1e-9).alias("off_margin"), F.lit(int(mean > 1e-9)).cast("long").alias("off_mean"))


@register("logit_all_features", stage2(
    "SELECT count(*) AS n_rows, CAST(14 AS BIGINT) AS n_variables, CAST(0 AS BIGINT) AS unexplained, CAST(0.0 AS DOUBLE) AS max_abs_score FROM mdl"))
def q_logit_all_features(spark, sf_dir):
    """The inference table of all 13 features: every variable has statistics or a reason, and the score equations are 0.

    The score (with Jeffreys' term where the table says that the classes are separated) is recomputed by SQL sums from the
    table's coefficients.
    """
    m = model_rows(spark, sf_dir)
    feats = FE.available_features(m)
    data = MO.impute(m, MO.fit_medians(m, feats)).withColumn("const", F.lit(1.0))
    table = INF.logit_inference(m, feats, FE.LABEL, separated="jeffreys").collect()
    used = [r["variable"] for r in table if r["coefficient"] is not None]
    x = [q(c).cast("double") for c in used]
    p = F.lit(1.0) / (1 + F.exp(-sum((F.lit(r["coefficient"]) * c for r, c in zip([r for r in table if r["coefficient"] is not None], x)), F.lit(0.0))))
    rows = data.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], p.alias("p"), F.col(FE.LABEL).alias("y"))
    k, w = len(used), F.col("p") * (1 - F.col("p"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(*[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
    information = np.zeros((k, k))
    for (i, j), v in zip(pairs, sums):
        information[i, j] = information[j, i] = v
    off = F.col("y") - F.col("p")
    if any((r["note"] or "").startswith("separates") for r in table):
        inverse = np.linalg.inv(information)
        lever = sum((F.lit(float(inverse[i, j] * (1 if i == j else 2))) * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs), F.lit(0.0))
        off = off + w * lever * (F.lit(0.5) - F.col("p"))
    scores = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.greatest(*[F.abs(F.sum(off * F.col(f"x{i}"))) for i in range(k)], F.lit(0.0)).alias("worst"))
    unexplained = sum(r["coefficient"] is None and r["note"] is None for r in table)
    return scores.select("n_rows", F.lit(len(table)).cast("long").alias("n_variables"), F.lit(unexplained).cast("long").alias("unexplained"),
                         F.when(F.col("worst") < 1e-5, F.lit(0.0)).otherwise(F.col("worst")).alias("max_abs_score"))


NEW_PERIOD = "1999-01-01"  # on the test tables: rows before it train the model, rows from it on are the new period


def period_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Enriched rows that began before, and from, the new period on."""
    enriched, _ = enriched_and_model(spark, sf_dir)
    began = F.col("FIRST_MRR_MONTH") < F.lit(NEW_PERIOD).cast("date")
    return enriched.filter(began), enriched.filter(~began)


@register("score_new_period", stage2(f"""
SELECT CASE CHURN_OR_RETAIN WHEN 'Churn' THEN 1 ELSE 0 END AS y_true, count(*) AS n,
       round(sum(CAST(STARTING_MRR AS DOUBLE)), 2) AS starting_mrr, CAST(0 AS BIGINT) AS off_label
FROM enr WHERE FIRST_MRR_MONTH >= DATE '{NEW_PERIOD}' GROUP BY 1"""))
def q_score_new_period(spark, sf_dir):
    """Out-of-time scoring: train before a date, save, load, score what began after it.

    The new rows are encoded with the training levels, so a level they lack is 0
    and one the training rows lacked adds no column.  Starting revenue is summed
    by true and predicted label with the tuned threshold; the result adds both
    predictions up (the fitted split of the sums has no oracle) and counts rows
    whose label disagrees with the loaded parameters.
    """
    from ..sources.files import export_path

    def fit():
        before, _ = period_rows(spark, sf_dir)
        levels = FE.one_hot_levels(before, ColumnPlan(before).present(FE.DUMMY_COLUMNS))
        rows = FE.model_frame(before, levels)
        feats = FE.available_features(rows)
        model = MO.train_churn_model(MO.stratified_split(rows.select(FE.ROW_ID, FE.LABEL, *[X.finite_or_null(q(f)).alias(f) for f in feats])), feats)
        path = export_path(spark, "period_model")
        MO.save_model(model, path)
        return path, levels
    path, levels = remembered(spark, sf_dir, "period_model", fit)
    model = MO.load_model(path)
    _, after = period_rows(spark, sf_dir)
    new = FE.model_frame(after, levels)
    missing = {f: F.lit(0) for f in model.features if f not in new.columns}
    scored = MO.score_rows(new.withColumns(missing) if missing else new, model, FE.LABEL, keep=["Starting Mrr"])
    sums = scored.groupBy("y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n"), F.sum(q("Starting Mrr").cast("double")).alias("starting_mrr"),
        F.count_if((F.col("y_proba") >= model.threshold).cast("int") != F.col("y_pred")).alias("off_label"))
    return sums.groupBy("y_true").agg(F.sum("n").alias("n"), F.round(F.sum("starting_mrr"), 2).alias("starting_mrr"),
                                      F.sum("off_label").alias("off_label"))


@register("saved_model_scores", stage2("SELECT count(*) AS n_rows, CAST(0.0 AS DOUBLE) AS max_abs_diff FROM mdl"))
def q_saved_model_scores(spark, sf_dir):
    """The fitted model is saved to the shared store, loaded back and applied to
    every row; the scores must equal the in-memory model's."""
    from ..sources.files import export_path
    m, feats, model = fitted(spark, sf_dir)
    path = export_path(spark, "churn_model")
    MO.save_model(model, path)
    loaded = MO.load_model(path)
    a = MO.score_rows(m, model, FE.LABEL, keep=[FE.ROW_ID]).withColumnRenamed("y_proba", "p_mem")
    b = MO.score_rows(m, loaded, FE.LABEL, keep=[FE.ROW_ID]).select(FE.ROW_ID, F.col("y_proba").alias("p_disk"))
    j = a.join(b, FE.ROW_ID, "full")
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.coalesce(F.max(F.abs(F.col("p_mem") - F.col("p_disk"))), F.lit(0.0)).alias("max_abs_diff"))


@register("write_counts", stage2("SELECT count(*) AS rows_written FROM mdl"))
def q_write_counts(spark, sf_dir):
    """Rows written by the scored-rows sink, observed during the write."""
    from ..sources.files import export_path, write_counted
    n = write_counted(coef_scored(spark, sf_dir), export_path(spark, "scored_rows"))
    return spark.createDataFrame([(n,)], "rows_written LONG")


@register("lifetime_stats_sql", stage1("SELECT * FROM life"))
def q_lifetime_stats_sql(spark, sf_dir):
    """Lifetime figures as SQL text through ``spark.sql``: the months from a customer's last start on."""
    from ..sources.files import run_query
    from .queries_cohort import _src
    src = _src(spark, sf_dir)
    sql = """
    SELECT m.customer_id, CAST(sum(m.total_mrr) AS DECIMAL(38,2)) AS lifetime_value,
           count(*) AS lifetime_months, min(m.month_ending) AS first_month
    FROM mrr_by_location m
    JOIN (SELECT customer_id, max(month_ending) AS began FROM mrr_by_location WHERE is_new GROUP BY customer_id) s
      ON s.customer_id = m.customer_id
    WHERE m.month_ending >= s.began
    GROUP BY m.customer_id"""
    return run_query(spark, sql, {"mrr_by_location": src["mrr_by_location"]})


@register("best_threshold_precision_rule", stage2s(f"""
SELECT {_rs('threshold')} AS threshold, {_rs('precision')} AS precision, {_rs('recall')} AS recall
FROM prf WHERE precision >= 0.30 ORDER BY recall DESC, threshold ASC LIMIT 1""", PR_CTE))
def q_best_threshold_precision_rule(spark, sf_dir):
    """Alternative rule: the highest-recall threshold whose precision reaches 0.30."""
    b = EV.best_threshold(_val_pr(spark, sf_dir), rule="precision", min_precision=0.30)
    return b.select(_r("threshold").alias("threshold"), _r("precision").alias("precision"),
                    _r("recall").alias("recall"))
