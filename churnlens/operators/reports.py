"""Dashboard aggregates: every page is a handful of small DataFrames built by
grouped aggregation over the scored or segmented rows.

Top-k results use ``orderBy(...).limit(k)`` (a TakeOrderedAndProject: each
task keeps k rows, so the driver receives k x tasks rows at most); per-group
top-k first reduces rows to one per (group, value) by an aggregate, then
takes the top k in two salted phases (``ranking.top_n_per_group``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import q
from .exact_sums import exact_sums
from .ranking import top_n_per_group
from .selection import exact_quantiles

# Pain-point themes (any keyword, lower-cased substring; a row
# may count under several themes).
THEMES = {
    "Integration/Data Sync Issues": ["integration", "sync", "pms", "data"],
    "Support/Onboarding Issues": ["support", "onboarding", "training", "help"],
    "Technical Issues": ["technical", "bug", "system", "error", "problem"],
    "Pricing Concerns": ["price", "cost", "expensive", "pricing"],
}


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) of non-null values."""
    return df.filter(q(col).isNotNull()).groupBy(q(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def top_values_pct(df: DataFrame, cols: Sequence[str], k: int = 5, digits: int = 1) -> DataFrame:
    """Top-k values by count (ties by value) of each column, with their percentage of all rows.

    One pass over the rows counts (column, value) pairs, nulls included, so the
    counts of a column also add up to the number of rows.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols]))
    counts = (df.select(pair.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("count")))
    totals = counts.groupBy(F.col("column").alias("_c")).agg(F.sum("count").alias("_total"))  # a row per column
    top = top_n_per_group(counts.where(F.col("value").isNotNull()), ["column"], [F.col("count").desc(), F.col("value")],
                          k, salt_key=F.col("value"), rank_col="_rank")
    return top.join(F.broadcast(totals), F.col("column") == F.col("_c")).select(
        "column", "value", "count", F.round(F.col("count") * 100.0 / F.col("_total"), digits).alias("pct"))


def tenure_revenue_summary(df: DataFrame, tenure: str, revenue: str) -> DataFrame:
    """Mean and median tenure, mean and total revenue: exact, interpolated median, sums in any order of the rows."""
    median = exact_quantiles(df, {"t": (q(tenure), [0.5])})["t"][0]
    sums = exact_sums(df, {"_t": q(tenure), "_r": q(revenue)}, _nt=F.count(q(tenure)), _nr=F.count(q(revenue)))
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    return sums.select(mean("_t", "_nt").alias("avg_tenure"), F.lit(median).cast("double").alias("median_tenure"),
                       mean("_r", "_nr").alias("avg_revenue"), F.col("_r").alias("total_revenue"))


def segment_sizes(df: DataFrame, segment: str) -> DataFrame:
    """Size of each segment, sorted by segment, with the segment count, total and average size.

    The grouped table has one row per segment; its totals come back as one row.
    """
    g = df.groupBy(q(segment).alias("segment")).agg(F.count(F.lit(1)).alias("size"))
    t = g.agg(F.count(F.lit(1)), F.sum("size"), F.avg("size")).first()
    return g.select("segment", "size", F.lit(t[0]).alias("n_segments"), F.lit(t[1]).alias("total"),
                    F.lit(t[2]).alias("avg_size")).orderBy("segment")


def with_position(df: DataFrame, col: str = "position") -> DataFrame:
    """A sorted result (a report of few rows) with each row's place, counted over its partitions in order."""
    placed = df.withColumn("_id", F.monotonically_increasing_id())  # rises with the order of a sorted frame
    sizes = placed.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    joined = placed.withColumn("_p", F.shiftright("_id", 33)).join(F.broadcast(sizes), "_p")
    return joined.withColumn(col, (F.col("_off") + F.col("_id") - F.shiftleft("_p", 33) + 1).cast("long")).drop("_id", "_p", "_off")


def theme_counts(df: DataFrame, text: str, themes: Mapping[str, Sequence[str]] = THEMES) -> DataFrame:
    """Rows whose lower-cased text contains any keyword of each theme (non-exclusive)."""
    low = F.lower(q(text))
    aggs = []
    for i, (name, words) in enumerate(themes.items()):
        hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        aggs.append(F.count_if(F.coalesce(hit, F.lit(False))).alias(f"t{i}"))
    row = df.agg(*aggs)
    names = list(themes)
    return reduce(DataFrame.unionByName, [
        row.select(F.lit(n).alias("theme"), F.col(f"t{i}").alias("customers")) for i, n in enumerate(names)])


def top_k_per_group(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """Top-k values by count inside each group (ties by value): (grp, value, count, rank).

    Counts are aggregated first (map-side combined); the per-group top-k then
    runs in two salted phases so a group with many values is not one task.
    """
    counts = (df.filter(q(value).isNotNull()).groupBy(q(group).alias("grp"), q(value).alias("value"))
              .agg(F.count(F.lit(1)).alias("count")))
    return top_n_per_group(counts, ["grp"], [F.col("count").desc(), F.col("value")], k,
                           salt_key=F.col("value"), rank_col="rank")


def _money(x):
    """Two-decimal text of a number: round the double half-up, then print as a plain decimal."""
    return F.round(x.cast("double"), 2).cast("decimal(38,2)").cast("string")


def industry_profiles(df: DataFrame, industry: str, pms: str, bundle: str, mrr: str, tenure: str,
                      n_industries: int = 4, n_pms: int = 3, n_bundles: int = 2) -> DataFrame:
    """Per top industry: size, average revenue and tenure, and its top PMS / bundle values.

    Long format (industry, kind, rank, value, count) so it stays a plain table.
    """
    top = (value_counts(df, industry).orderBy(F.col("count").desc(), F.col("value")).limit(n_industries)
           .select(F.col("value").alias("grp"), F.col("count").alias("customers")))
    base = df.join(F.broadcast(top.select("grp")), q(industry) == F.col("grp"), "left_semi")
    stats = base.groupBy(q(industry).alias("grp")).agg(F.avg(q(mrr)).alias("avg_mrr"),
                                                       F.avg(q(tenure)).alias("avg_tenure"))
    pms_top = top_k_per_group(base, industry, pms, n_pms).withColumn("kind", F.lit("pms"))
    bun_top = top_k_per_group(base, industry, bundle, n_bundles).withColumn("kind", F.lit("bundle"))
    summary = top.join(stats, "grp").select(
        "grp", F.lit("summary").alias("kind"), F.lit(0).alias("rank"),
        F.concat(F.lit("avg_mrr="), _money(F.col("avg_mrr")),
                 F.lit(" avg_tenure="), _money(F.col("avg_tenure"))).alias("value"),
        F.col("customers").alias("count"))
    parts = [summary, pms_top.select("grp", "kind", "rank", F.col("value").cast("string"), "count"),
             bun_top.select("grp", "kind", "rank", F.col("value").cast("string"), "count")]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("grp", "industry")


def context_report(rows: DataFrame, labelled: DataFrame, segment: str, top_columns: Sequence[str],
                   themes: Mapping[str, Sequence[str]] = THEMES) -> DataFrame:
    """The report behind the assistant page as (section, key, value) lines.

    ``rows`` are all churned rows, ``labelled`` those with a segment.  Sections:
    overview, segment, tenure, revenue, example and reason (three rows a
    segment), industry with averages, software and bundles (four largest),
    top_<column>, pain_point.  Every part is a grouped aggregate or a top n.
    """
    from .segments import segment_examples

    def lines(df: DataFrame, section: str, key, value) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))

    def fixed(df: DataFrame, section: str, values: Mapping[str, object]) -> list[DataFrame]:
        return [lines(df, section, F.lit(k), v) for k, v in values.items()]

    money = lambda c, d: F.concat(F.lit("$"), F.format_string(f"%,.{d}f", F.round(c.cast("double"), d)))
    plain = lambda c: F.concat(F.lit("$"), F.format_string("%.0f", F.round(c.cast("double"))))
    months = lambda c: F.format_string("%.1f months", F.round(c.cast("double"), 1))
    sizes = segment_sizes(labelled, segment)
    overall = sizes.select("n_segments", "total", "avg_size").limit(1)
    tenure = tenure_revenue_summary(rows, "LIFETIME_MONTHS", "STARTING_MRR")
    examples = segment_examples(labelled, segment)
    place = F.concat_ws(".", q(segment).cast("string"), F.col("example").cast("string"))
    profiles = industry_profiles(rows, "CORE_INDUSTRY", "PRACTICE_MANAGEMENT_SOFTWARE", "STARTING_BUNDLE", "STARTING_MRR",
                                 "LIFETIME_MONTHS").withColumn("name", F.upper("industry"))
    shown = rows.join(F.broadcast(profiles.where("kind = 'summary'").select(F.col("industry").alias("_i"))),  # four rows
                      F.col("CORE_INDUSTRY") == F.col("_i"))
    averages = shown.groupBy("CORE_INDUSTRY").agg(F.avg(F.col("STARTING_MRR").cast("double")).alias("mrr"), F.avg("LIFETIME_MONTHS").alias("tenure"))
    ranked = F.concat_ws(" ", "name", F.col("rank").cast("string"))
    parts = [
        *fixed(overall, "overview", {"segments": F.col("n_segments"), "customers": F.format_string("%,d", F.col("total").cast("long")),
                                     "average size": F.format_string("%.0f", F.round("avg_size"))}),
        lines(sizes, "segment", F.col("segment"), F.concat_ws(" ", F.col("size").cast("string"), F.lit("customers"))),
        *fixed(tenure, "tenure", {"average": months(F.col("avg_tenure")), "median": months(F.col("median_tenure"))}),
        *fixed(tenure, "revenue", {"average": money(F.col("avg_revenue"), 2), "total": money(F.col("total_revenue"), 2)}),
        lines(examples, "example", place, F.concat(
            "LOCATION_NAME", F.lit(" ("), "CORE_INDUSTRY", F.lit(") - "), plain(F.col("STARTING_MRR")), F.lit(" MRR, "),
            F.col("LIFETIME_MONTHS").cast("string"), F.lit(" months, "), "PRACTICE_MANAGEMENT_SOFTWARE", F.lit(" PMS"))),
        lines(examples, "reason", place, F.concat("reason_excerpt", F.lit("..."))),
        lines(profiles.where("kind = 'summary'"), "industry", F.col("name"), F.concat_ws(" ", F.col("count").cast("string"), F.lit("customers"))),
        lines(averages, "industry_average", F.upper("CORE_INDUSTRY"), F.concat(plain(F.col("mrr")), F.lit(" MRR, "), months(F.col("tenure")))),
        lines(profiles.where("kind = 'pms'"), "industry_pms", ranked, F.format_string("%s (%d)", "value", "count")),
        lines(profiles.where("kind = 'bundle'"), "industry_bundle", ranked, F.col("value")),
        top_values_pct(rows, top_columns, 5).select(F.concat(F.lit("top_"), "column").alias("section"), F.col("value").alias("key"),
                                                    F.format_string("%d customers (%.1f%%)", "count", "pct").alias("value")),
        lines(theme_counts(rows, "SWAT_CANCEL_SUMMARY", themes), "pain_point", F.col("theme"),
              F.concat_ws(" ", F.col("customers").cast("string"), F.lit("customers")))]
    return reduce(DataFrame.unionByName, parts)


def risk_threshold(df: DataFrame, risk: str, quantile: float = 0.8) -> float | None:
    """Exact quantile of the risk column (linear interpolation), without a one-task value map."""
    return exact_quantiles(df, {"risk": (q(risk), [quantile])})["risk"][0]


def high_risk_top(df: DataFrame, risk: str, key: str, quantile: float = 0.8, k: int = 20) -> DataFrame:
    """Rows at or above the risk quantile (linear interpolation), top k by risk then key."""
    thr = risk_threshold(df, risk, quantile)
    return df.filter(q(risk) >= F.lit(thr)).orderBy(q(risk).desc(), q(key)).limit(k)


def fixed_histogram(df: DataFrame, col: str, bins: int = 50, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Counts in ``bins`` equal-width bins over [lo, hi]; the top edge falls in the last bin, values outside are left out."""
    span, x = float(hi - lo), q(col)
    b = F.least(F.floor((x - F.lit(float(lo))) * F.lit(bins) / F.lit(span)), F.lit(bins - 1)).cast("int")
    start = F.lit(float(lo)) + F.col("bin").cast("double") * F.lit(span) / F.lit(bins)
    return (df.filter(x.between(float(lo), float(hi))).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("bin", start.alias("bin_start"), "n"))


def churn_by_group(df: DataFrame, group: str, label: str, proba: str = "p_churn",
                   risk: str | None = "business_risk_index", digits: int = 3) -> DataFrame:
    """Customers, churned, churn rate, mean probability (and mean risk) per group; null groups dropped."""
    aggs = [F.count(q(label)).alias("Total_Customers"), F.sum(q(label)).cast("long").alias("Churned_Customers"),
            F.round(F.avg(q(label)), digits).alias("Churn_Rate"),
            F.round(F.avg(q(proba)), digits).alias("Avg_Churn_Prob")]
    if risk:
        aggs.append(F.round(F.avg(q(risk)), digits).alias("Avg_Risk_Index"))
    return df.filter(q(group).isNotNull()).groupBy(q(group)).agg(*aggs)


def coefficient_view(coefs: DataFrame, descending: bool = True, k: int | None = 10) -> DataFrame:
    """Coefficients with |coefficient|, interpretation and sort by magnitude."""
    from ..functions.expressions import coefficient_interpretation
    out = coefs.select("variable", "coefficient", F.abs("coefficient").alias("abs_coefficient"),
                       coefficient_interpretation("coefficient").alias("interpretation"))
    order = F.col("abs_coefficient").desc() if descending else F.col("abs_coefficient").asc()
    out = out.orderBy(order, F.col("variable"))
    return out.limit(k) if k else out
