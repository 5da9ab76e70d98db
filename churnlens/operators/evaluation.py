"""Binary-classification evaluation as Spark aggregates.

Curves are built on the table of distinct scores (one partial aggregate),
then cumulative counts come from the range-partitioned ``prefix_sums``;
scalar totals are scalar subqueries, never a driver round trip.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleaning import q
from .ranking import prefix_sums
from .selection import exact_quantiles


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, pos, neg) per distinct score."""
    y = q(label).cast("long")
    return (df.filter(q(score).isNotNull())
            .groupBy(q(score).alias("threshold"))
            .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))


def pr_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision, recall and F1 of the rule ``score >= threshold`` at every distinct score."""
    g = score_counts(df, label, score)
    totals = g.agg(F.sum("pos"), F.sum("neg")).first()  # one row
    total_pos, total_neg = F.lit(int(totals[0] or 0)), F.lit(int(totals[1] or 0))
    cum = prefix_sums(g, [F.col("threshold").desc()], ["pos", "neg"])
    tp, fp = F.col("pos_cum"), F.col("neg_cum")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(total_pos > 0, tp / total_pos).otherwise(F.lit(1.0))
    out = cum.select("threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"),
                     precision.alias("precision"), recall.alias("recall"),
                     total_pos.alias("total_pos"), total_neg.alias("total_neg"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(
        F.col("precision") + F.col("recall"), F.lit(1e-12))
    return out.withColumn("f1", f1)


def best_threshold(pr: DataFrame, rule: str = "f1", min_precision: float = 0.30) -> DataFrame:
    """One row: the F1-maximising threshold (lowest threshold on ties), or with
    ``rule='precision'`` the highest-recall threshold whose precision reaches the floor."""
    if rule == "precision":
        cand = pr.filter(F.col("precision") >= min_precision)
        return cand.orderBy(F.col("recall").desc(), F.col("threshold").asc()).limit(1)
    return pr.orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)


def curve_summary(pr: DataFrame) -> DataFrame:
    """ROC AUC (ties count one half) and average precision from a ``pr_table``."""
    p, n = F.first("total_pos").cast("double"), F.first("total_neg").cast("double")  # their product passes 32 bits
    neg_below = F.col("total_neg") - F.col("fp")
    auc_num = F.sum(F.col("pos") * (neg_below + 0.5 * F.col("neg")))
    ap = F.sum(F.col("pos") * F.col("precision"))
    return pr.agg((auc_num / (p * n)).alias("roc_auc"), (ap / p).alias("average_precision"))


def confusion_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    y, yhat = q(label).cast("int"), q(pred).cast("int")
    return df.agg(
        F.count_if((y == 0) & (yhat == 0)).alias("tn"), F.count_if((y == 0) & (yhat == 1)).alias("fp"),
        F.count_if((y == 1) & (yhat == 0)).alias("fn"), F.count_if((y == 1) & (yhat == 1)).alias("tp"))


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy and binary precision/recall/F1 (0 where undefined)."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    prec, rec = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    return c.select(_safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    _safe_div(2 * prec * rec, prec + rec).alias("f1"))


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """All four (y_true, y_pred) cells, zero cells included."""
    c = confusion_counts(df, label, pred)
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return reduce(DataFrame.unionByName, [
        c.select(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.col(k).alias("n"))
        for a, b, k in cells])


def classification_report(df: DataFrame, label: str, pred: str, digits: int = 4) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted averages."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1 = _safe_div(2 * p1 * r1, p1 + r1)
    f0 = _safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    acc = _safe_div(tp + tn, total)
    r = lambda x: F.round(x, digits)
    rows = [
        ("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
        ("accuracy", F.lit(None), F.lit(None), acc, total),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
        ("weighted avg", _safe_div(p0 * s0 + p1 * s1, total), _safe_div(r0 * s0 + r1 * s1, total),
         _safe_div(f0 * s0 + f1 * s1, total), total),
    ]
    return reduce(DataFrame.unionByName, [
        c.select(F.lit(k).alias("class"), r(a).cast("double").alias("precision"),
                 r(b).cast("double").alias("recall"), r(d).cast("double").alias("f1_score"),
                 e.cast("long").alias("support"))
        for k, a, b, d, e in rows])


def probability_summary(df: DataFrame, col: str, digits: int = 4, exact: bool = True) -> DataFrame:
    """count, mean, std, min, 10/50/90 % (linear interpolation), max."""
    x = q(col)
    if exact:  # order statistics from a range-partitioned rank (no one-task value map)
        vals = exact_quantiles(df, {"x": (x, [0.1, 0.5, 0.9])})["x"]
        pct = F.array(*[F.lit(v).cast("double") for v in vals])
    else:
        pct = F.percentile_approx(x, [0.1, 0.5, 0.9], 10000)
    s = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
               F.min(x).alias("min"), pct.alias("p"), F.max(x).alias("max"))
    r = lambda c: F.round(c, digits)
    return s.select(F.col("count").cast("double").alias("count"), r("mean").alias("mean"),
                    r("std").alias("std"), r("min").alias("min"), r(F.col("p")[0]).alias("p10"),
                    r(F.col("p")[1]).alias("p50"), r(F.col("p")[2]).alias("p90"),
                    r("max").alias("max"))


def class_balance(df: DataFrame, split: str, label: str, digits: int = 3) -> DataFrame:
    """Share of each label within each split."""
    g = df.groupBy(q(split).alias("split"), q(label).alias("label")).count()
    tot = g.groupBy("split").agg(F.sum("count").alias("n"))
    return g.join(tot, "split").select("split", "label",
                                       F.round(F.col("count") / F.col("n"), digits).alias("share"))
