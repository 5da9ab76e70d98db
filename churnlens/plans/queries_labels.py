"""Model operators on a larger labelled view: quality labels of documents with built-in text features.

The churn rows of the test tables are few, so the fitted half of the library is
checked here: closed forms, score equations and the max-min form of isotonic
regression, all stated in SQL over the same view.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as EV
from ..operators import features as FE
from ..operators import inference as INF
from ..operators import modeling as MO
from ..operators import reports as RP
from ..operators.exact_sums import exact_sums
from ..operators.smote import smote
from ..operators.text_model import fit_text_model
from ..session import cut_lineage
from ..sources.testdata import read_table
from .handoff import write_once
from .registry import TESTDATA_PARAMS, register
from .stages import materialised, remembered

NUMERIC = ["n_words", "n_lines", "word_length"]
LANGS = ["de", "es", "fr"]  # against en
FLAGS = [f"lang_{v}" for v in LANGS]

VIEW_SQL = """
v AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS row_id, l.quality AS y, d.lang, d.source,
    CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS DOUBLE) AS n_words,
    CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS DOUBLE) AS n_lines,
    length(d.text) / CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS DOUBLE) AS word_length,
    CAST(d.lang = 'de' AS INTEGER) AS lang_de, CAST(d.lang = 'es' AS INTEGER) AS lang_es,
    CAST(d.lang = 'fr' AS INTEGER) AS lang_fr
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL
)"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([VIEW_SQL, *ctes]) + "\n" + body


def _label_rows_builder(spark: SparkSession, sf_dir: str):
    def build():
        labels = read_table(spark, sf_dir, "labels").where("quality IS NOT NULL")
        docs = read_table(spark, sf_dir, "documents")
        spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
        breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
        rows = labels.join(docs.drop("n_chars"), "doc_id").select(
            F.col("doc_id").cast("string").alias("row_id"), F.col("quality").alias("y"), "lang", "source",
            (spaces + 1).cast("double").alias("n_words"), (breaks + 1).cast("double").alias("n_lines"),
            (F.length("text") / (spaces + 1).cast("double")).alias("word_length"),
            *[(F.col("lang") == v).cast("int").alias(f"lang_{v}") for v in LANGS])
        return MO.stratified_split(cut_lineage(rows), label="y")
    return build


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y (quality), text features, language flags, split: a hand-off."""
    return materialised(spark, sf_dir, "label_rows", _label_rows_builder(spark, sf_dir))


@register("stage_reuse", sql("""
SELECT 'label_rows' AS stage, count(*) AS rows_in_marker, count(*) AS rows_read, false AS built_again, true AS same_table FROM v"""))
def q_stage_reuse(spark, sf_dir):
    """A stage asked for by two sessions that share no memory of it: the marker shows that the second read the first's table."""
    asked = []
    for _ in range(2):
        session = spark.newSession()
        asked.append(write_once(session, sf_dir, "label_rows", _label_rows_builder(session, sf_dir), TESTDATA_PARAMS))
    first, second = asked
    found = second.read(spark).agg(F.count(F.lit(1)).alias("rows_read"))
    return found.select(F.lit(second.marker["stage"]).alias("stage"), F.lit(second.marker["rows"]).cast("long").alias("rows_in_marker"), "rows_read",
                        F.lit(second.built).alias("built_again"), F.lit(first.marker["attempt"] == second.marker["attempt"]).alias("same_table"))


@register("label_view", sql("SELECT row_id, y, lang, source, n_words, n_lines, round(word_length, 9) AS word_length FROM v"))
def q_label_view(spark, sf_dir):
    return label_rows(spark, sf_dir).select("row_id", "y", "lang", "source", "n_words", "n_lines",
                                            F.round("word_length", 9).alias("word_length"))


_SOURCES = [f"src{i}" for i in range(20)]


@register("one_hot", sql("SELECT row_id, " + ", ".join(
    [f"CAST(lang = '{v}' AS TINYINT) AS lang_{v}" for v in ("de", "en", "es", "fr")]
    + [f"CAST(source = '{v}' AS TINYINT) AS source_{v}" for v in _SOURCES]) + " FROM v"))
def q_one_hot(spark, sf_dir):
    """Every level of two columns as a 0/1 column."""
    return FE.one_hot(label_rows(spark, sf_dir).select("row_id", "lang", "source"), ["lang", "source"])


# --------------------------------------------------------------------- inference in closed form
# With one flag per language the logit is saturated: every estimate is a log odds, every variance a sum of 1/n.
LOGIT_CTE = """
cell AS (SELECT lang, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM v GROUP BY lang),
co AS (
  SELECT 'const' AS variable, ln(n1 / n0) AS b, sqrt(1 / n1 + 1 / n0) AS se FROM cell WHERE lang = 'en'
  UNION ALL
  SELECT 'lang_' || c.lang, ln(c.n1 / c.n0) - ln(e.n1 / e.n0), sqrt(1 / c.n1 + 1 / c.n0 + 1 / e.n1 + 1 / e.n0)
  FROM cell c, (SELECT * FROM cell WHERE lang = 'en') e WHERE c.lang <> 'en'),
inf AS (
  SELECT variable, b, se, b / se AS z,
    CASE WHEN abs(b / se) > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 100), lambda k: pow(-1, k) * pow(abs(b / se) / sqrt(2), 2 * k + 1)
                                                 / (gamma(k + 1) * (2 * k + 1)))) END AS p
  FROM co)"""


def label_inference(spark, sf_dir) -> DataFrame:
    return remembered(spark, sf_dir, "label_inference", lambda: INF.logit_inference(label_rows(spark, sf_dir), FLAGS, "y", impute_median=False))


@register("logit_coefficients", sql("""
SELECT variable, round(b, 6) AS coefficient, round(se, 6) AS std_err, round(z, 5) AS z_score, round(p, 5) AS p_value,
       round(b - 1.959963984540054 * se, 5) AS ci_low, round(b + 1.959963984540054 * se, 5) AS ci_high,
       round(exp(b), 5) AS odds_ratio, round((exp(b) - 1) * 100, 3) AS pct_odds_change_per_unit FROM inf""", LOGIT_CTE))
def q_logit_coefficients(spark, sf_dir):
    t = label_inference(spark, sf_dir)
    r = lambda c, d: F.round(c, d).alias(c)
    return t.select("variable", r("coefficient", 6), r("std_err", 6), r("z_score", 5), r("p_value", 5), r("ci_low", 5),
                    r("ci_high", 5), r("odds_ratio", 5), r("pct_odds_change_per_unit", 3))


_SIGN = "CASE WHEN b > 0 THEN 'Increases churn risk' ELSE 'Decreases churn risk' END"


def _view(t: DataFrame) -> DataFrame:
    return t.withColumns({"coefficient": F.round("coefficient", 6), "abs_coefficient": F.round("abs_coefficient", 6)})


# --------------------------------------------------------------------- fitted, calibrated model
def label_model(spark, sf_dir):
    """Balanced, calibrated logistic model of the label view (fitted once per session and folder)."""
    def build():
        rows = label_rows(spark, sf_dir)
        return MO.train_churn_model(rows, [*NUMERIC, *FLAGS], label="y")
    return remembered(spark, sf_dir, "label_model", build)


@register("balanced_logit", sql("SELECT count(*) AS n_rows, CAST(0.0 AS DOUBLE) AS max_abs_gradient FROM v"))
def q_balanced_logit(spark, sf_dir):
    """The fitted model solves the balanced, penalised score equations of its training rows."""
    rows, model = label_rows(spark, sf_dir), label_model(spark, sf_dir)
    train = F.when(F.col("split") == "train", 1.0).otherwise(0.0)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin()))
    r = train * MO.weight_column("y", model.weights) * (p - F.col("y"))
    slopes = [F.sum(r).alias("g0")]
    for c, b in zip(model.features, model.coefficients):
        mean, std = model.scaler[c]
        slopes.append((F.sum(r * ((F.col(c) - F.lit(mean)) / F.lit(std))) + F.lit(b)).alias(f"g{len(slopes)}"))
    g = rows.agg(F.count(F.lit(1)).alias("n_rows"), *slopes)
    worst = F.greatest(*[F.abs(F.col(c)) for c in g.columns if c != "n_rows"])
    return g.select("n_rows", F.when(worst < 1e-3, F.lit(0.0)).otherwise(worst).alias("max_abs_gradient"))


@register("standardised_coefficients", sql(
    "SELECT feature, CAST(0 AS INTEGER) AS off FROM (VALUES " + ", ".join(f"('{f}')" for f in [*NUMERIC, *FLAGS]) + ") t(feature), "
    "(SELECT count(*) AS n FROM v) c WHERE c.n > 0"))
def q_standardised_coefficients(spark, sf_dir):
    """Per-unit coefficients and odds ratios against the training rows' own spread (0: all agree)."""
    table = MO.coefficient_table(label_model(spark, sf_dir))
    train = label_rows(spark, sf_dir).where("split = 'train'")
    spread = train.agg(*[F.stddev_pop(c).alias(c) for c in [*NUMERIC, *FLAGS]])
    spread = spread.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_f"), F.col(c).cast("double").alias("_sd")) for c in [*NUMERIC, *FLAGS]])).alias("s")).select("s.*")
    off = ((F.abs(F.col("coef_per_unit") * F.col("_sd") - F.col("coef_per_sd")) > 1e-9)
           | (F.abs(F.log("odds_ratio_per_sd") - F.col("coef_per_sd")) > 1e-9)
           | (F.abs(F.log("odds_ratio_per_unit") - F.col("coef_per_unit")) > 1e-9))
    return table.join(spread, F.col("feature") == F.col("_f")).select("feature", off.cast("int").alias("off"))


ISO_CTE = """
pt AS (SELECT word_length AS x, CAST(sum(y) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS w,
              row_number() OVER (ORDER BY word_length) AS k FROM v GROUP BY word_length),
cum AS (SELECT *, sum(s) OVER (ORDER BY k) AS cs, sum(w) OVER (ORDER BY k) AS cw FROM pt),
seg AS (SELECT a.k AS i, b.k AS j, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM cum a JOIN cum b ON a.k <= b.k),
low AS (SELECT p.k, seg.i, min(seg.m) AS m FROM pt p JOIN seg ON seg.i <= p.k AND seg.j >= p.k GROUP BY p.k, seg.i),
fit AS (SELECT k, max(m) AS m FROM low GROUP BY k)"""


@register("isotonic_calibration", sql(
    "SELECT round(pt.x, 9) AS score, round(fit.m, 9) AS calibrated FROM pt JOIN fit ON pt.k = fit.k", ISO_CTE))
def q_isotonic_calibration(spark, sf_dir):
    """Isotonic regression of the label on a score; SQL states the max-min form of the same fit."""
    rows = label_rows(spark, sf_dir)
    model = remembered(spark, sf_dir, "label_isotonic", lambda: MO.fit_isotonic(rows, "word_length", "y"))
    scores = rows.select("word_length").distinct()
    out = model.transform(scores, "word_length", "calibrated")
    return out.select(F.round("word_length", 9).alias("score"), F.round("calibrated", 9).alias("calibrated"))


# --------------------------------------------------------------------- evaluation on many distinct scores
CURVE_CTE = """
sc AS (SELECT word_length AS t, sum(y) AS pos, sum(1 - y) AS neg FROM v GROUP BY word_length),
cv AS (SELECT t, pos, neg, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(neg) OVER (ORDER BY t DESC) AS fp,
              sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM sc)"""


@register("label_pr_curve", sql("""
SELECT round(t, 9) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / (tp + fp), 9) AS precision, round(tp / np, 9) AS recall FROM cv""", CURVE_CTE))
def q_label_pr_curve(spark, sf_dir):
    pr = EV.pr_table(label_rows(spark, sf_dir), "y", "word_length")
    return pr.select(F.round("threshold", 9).alias("threshold"), F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                     F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@register("label_curve_summary", sql("""
SELECT round(sum(pos * ((nn - fp) + 0.5 * neg)) / (max(np) * max(nn)), 9) AS roc_auc,
       round(sum(pos * tp / (tp + fp)) / max(np), 9) AS average_precision FROM cv""", CURVE_CTE))
def q_label_curve_summary(spark, sf_dir):
    s = EV.curve_summary(EV.pr_table(label_rows(spark, sf_dir), "y", "word_length"))
    return s.select(F.round("roc_auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


@register("smote_rows", sql("""
SELECT y, 0 AS synthetic, count(*) AS n, CAST(0 AS BIGINT) AS off_segment FROM v GROUP BY y
UNION ALL SELECT 0, 1, CAST(sum(y) - sum(1 - y) AS BIGINT), 0 FROM v"""))
def q_smote_rows(spark, sf_dir):
    """Rows per class after oversampling, and synthetic rows off the segment from base row to neighbour."""
    rows = label_rows(spark, sf_dir).select("row_id", "y", *NUMERIC)
    out = smote(rows, NUMERIC, "y", trace=True)
    base = rows.select(F.col("row_id").alias("_base"), F.array(*NUMERIC).alias("_b"))
    members = rows.select(F.array(*NUMERIC).alias("_m"), F.col("y").alias("_my")).distinct()
    joined = (out.join(base, F.col("smote_base") == F.col("_base"), "left")
              .join(members, (F.col("smote_neighbour") == F.col("_m")) & (F.col("y") == F.col("_my")), "left"))
    wrong = F.lit(False)
    for i, c in enumerate(NUMERIC):
        point = F.col("_b")[i] + F.col("smote_gap") * (F.col("smote_neighbour")[i] - F.col("_b")[i])
        wrong = wrong | (F.abs(F.col(c) - point) > 1e-6)
    off = (F.col("synthetic") == 1) & (wrong | F.col("_m").isNull() | (F.col("smote_gap") < 0) | (F.col("smote_gap") >= 1))
    return joined.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off_segment"))


# --------------------------------------------------------------------- feature-importance page
@register("coef_by_magnitude", sql(f"""
SELECT variable, round(b, 6) AS coefficient, round(abs(b), 6) AS abs_coefficient, {_SIGN} AS interpretation
FROM inf ORDER BY abs(b) DESC, variable LIMIT 10""", LOGIT_CTE))
def q_coef_by_magnitude(spark, sf_dir):
    """Top-10 coefficients by absolute value with a sign interpretation."""
    return _view(RP.coefficient_view(label_inference(spark, sf_dir), True, 10))


@register("coef_interpretation", sql(f"""
SELECT variable, round(b, 6) AS coefficient, round(abs(b), 6) AS abs_coefficient, {_SIGN} AS interpretation
FROM inf ORDER BY abs(b), variable""", LOGIT_CTE))
def q_coef_interpretation(spark, sf_dir):
    """All coefficients, ascending by magnitude (the chart order), with interpretation."""
    return _view(RP.coefficient_view(label_inference(spark, sf_dir), False, None))


# --------------------------------------------------------------------- scoring a later period
# One flag and no penalty to speak of: the balanced fit has a closed form, so predicted labels can be stated in SQL.
PERIOD_CTE = """
per AS (SELECT avg(CAST(row_id AS BIGINT)) AS cut FROM v),
b0 AS (
  SELECT row_id, y, lang_fr AS f, row_number() OVER (PARTITION BY y ORDER BY md5(row_id || '|split-42'), row_id) AS rn,
    count(*) OVER (PARTITION BY y) AS nc FROM v, per WHERE CAST(row_id AS BIGINT) <= cut),
b AS (
  SELECT *, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + (2 * (nc - nt) + 4) // 8 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, (2 * nc + 5) // 10 AS nt FROM b0) t),
cell AS (SELECT f, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM b WHERE split = 'train' GROUP BY f),
p AS (SELECT f, (n1 / t1) / (n1 / t1 + n0 / t0) AS p FROM cell, (SELECT sum(n1) AS t1, sum(n0) AS t0 FROM cell) t),
g AS (SELECT p AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM b JOIN p ON b.f = p.f WHERE split = 'val' GROUP BY p),
c AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp, sum(pos) OVER () AS np FROM g),
best AS (SELECT threshold FROM c ORDER BY 2 * (tp / (tp + fp)) * (tp / np) / greatest(tp / (tp + fp) + tp / np, 1e-12) DESC, threshold LIMIT 1)"""


@register("new_period_by_predicted_label", sql("""
SELECT v.y AS y_true, CAST(p.p >= best.threshold AS INTEGER) AS y_pred, count(*) AS n, round(sum(v.n_words), 2) AS n_words
FROM v JOIN p ON v.lang_fr = p.f, per, best WHERE CAST(v.row_id AS BIGINT) > per.cut GROUP BY 1, 2""", PERIOD_CTE))
def q_new_period_by_predicted_label(spark, sf_dir):
    """Train on the earlier half of the rows, score the later half: counts and sums by true and predicted label."""
    rows = label_rows(spark, sf_dir).select("row_id", "y", "n_words", "lang_fr")
    number = F.col("row_id").cast("bigint")
    cut = rows.agg(F.avg(number)).first()[0]
    model = remembered(spark, sf_dir, "one_flag_model", lambda: MO.train_churn_model(
        MO.stratified_split(rows.where(number <= cut), label="y"), ["lang_fr"], label="y", C=1e9, calibrate=False))
    scored = MO.score_rows(rows.where(number > cut), model, "y", keep=["n_words"])
    return exact_sums(scored, {"n_words": F.col("n_words")}, [F.col("y_true"), F.col("y_pred")], n=F.count(F.lit(1))).withColumn("n_words", F.round("n_words", 2))


# --------------------------------------------------------------------- text model
_MODEL_WORDS, _MODEL_DIMS = 2000, 24


@register("text_model_invariants", f"""
WITH d AS (SELECT row_number() OVER () AS row, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^0-9a-z_]+'), lambda w: w <> '')) AS w
           FROM documents),
w AS (SELECT row, unnest(w) AS word FROM d),
top AS (SELECT word FROM w GROUP BY word ORDER BY count(*) DESC, word LIMIT {_MODEL_WORDS})
SELECT (SELECT count(*) FROM documents) AS n_texts, (SELECT count(*) FROM top) AS n_words,
  (SELECT count(DISTINCT row) FROM w WHERE word IN (SELECT word FROM top)) AS total_energy, 0::BIGINT AS off_orthonormal, 0::BIGINT AS off_energy""")
def q_text_model_invariants(spark, sf_dir):
    """A text model fitted on all documents: its axes are orthonormal, and what they hold and what is left add up to the matrix,
    whose energy is its number of rows with a known word."""
    texts = read_table(spark, sf_dir, "documents").select("text")
    model = remembered(spark, sf_dir, "text_model", lambda: fit_text_model(texts, "text", _MODEL_DIMS, _MODEL_WORDS))
    off = np.abs(model.axes.T @ model.axes - np.eye(model.axes.shape[1])).max()

    @F.pandas_udf("held double, rest double, known int")
    def energies(column: pd.Series) -> pd.DataFrame:
        out = []
        for text in column:
            at, value = model.row(text)
            found = value @ model.axes[at]
            rest = -model.axes @ found
            rest[at] += value
            out.append((float(found @ found), float(rest @ rest), int(len(at) > 0)))
        return pd.DataFrame(out, columns=["held", "rest", "known"])

    e = texts.select(energies("text").alias("e"))
    sums = e.agg(F.count(F.lit(1)).alias("n_texts"), F.sum("e.known").alias("total_energy"),
                 F.count_if(F.abs(F.col("e.held") + F.col("e.rest") - F.col("e.known")) > 1e-9).alias("off_energy"))
    return sums.select("n_texts", F.lit(len(model.words)).cast("long").alias("n_words"), "total_energy",
                       F.lit(int(off > 1e-9)).cast("long").alias("off_orthonormal"), "off_energy")
