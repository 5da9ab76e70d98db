"""Stage-1 queries (scans, cohort CTEs, wide row, cohort cleaning) with DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import column_catalog
from ..operators import cleaning, cohort as C
from ..operators.features import ROW_ID
from ..sources.testdata import load_sources
from ..sources.testdata_sql import with_views
from . import extract
from .stages import materialised, remembered
from .oracle_cohort import SOURCE_VIEWS, WIDE_CTE, cohort_clean_cte, cohort_kept_cte, stage1
from .registry import TESTDATA_PARAMS, register

P = TESTDATA_PARAMS
ROW_KEY = ["LOCATION_ID", "CHURN_MONTH", "STARTING_BUNDLE", "END_BUNDLE", "SWAT_CASE_ID", "FIRST_USAGE_REPORT_MONTH"]
LO, HI = P["churn_range"]
CLEAN = cohort_clean_cte(P["retain_min"], LO, HI, P["since"])
KEPT = cohort_kept_cte(P["retain_min"], LO, HI, P["since"])


def _src(spark: SparkSession, sf_dir: str):
    """The logical source tables as lazy plans over the driver tables.

    They are not written separately: the wide row, which reads each once, is
    the materialised hand-off.
    """
    return load_sources(spark, sf_dir)


def _m(spark, sf_dir):
    return C.active_history(_src(spark, sf_dir)["mrr_by_location"])


def wide_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row with its row id, written once per session and folder."""
    return materialised(spark, sf_dir, "wide", lambda: C.wide_customer_row({}, row_key=ROW_KEY, parts=_parts(spark, sf_dir)))


def _parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The parts of the wide row, written once per session."""
    return remembered(spark, sf_dir, "wide_parts", lambda: C.wide_parts(_src(spark, sf_dir), write_cases=True))


def cohort_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned stage-1 cohort, row id included (written once per session and folder).

    It is built from the parts of the wide row, for the locations that keep a row:
    where slugs repeat, the whole wide row is as large as the square of their rows.
    """
    def build():
        empty: list[str] = []

        def chosen(brief: DataFrame) -> DataFrame:
            locations, columns = extract.cohort_locations(brief, **P)
            empty.extend(columns)
            return locations
        wide = C.wide_customer_row({}, row_key=ROW_KEY, parts=_parts(spark, sf_dir), chosen=chosen)
        return extract.clean_cohort(wide, **P, empty_columns=empty)
    return materialised(spark, sf_dir, "cohort", build)


# --------------------------------------------------------------------- scans
_SCAN_NAMES = [n for n in SOURCE_VIEWS] + ["opportunity_stages_timeline"]


@register("scan_sources", with_views(
    "\nUNION ALL\n".join(f"SELECT '{n}' AS source_table, count(*) AS n_rows FROM {n}"
                         for n in _SCAN_NAMES), *_SCAN_NAMES))
def q_scan_sources(spark, sf_dir):
    src = _src(spark, sf_dir)
    parts = [src[n].agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(n).alias("source_table"), "n_rows") for n in _SCAN_NAMES]
    return reduce(DataFrame.unionByName, parts)


# --------------------------------------------------------------------- revenue history
@register("active_history", stage1(
    "SELECT customer_id, month_ending, total_mrr, is_lost, last_new_month FROM hist"))
def q_active_history(spark, sf_dir):
    return _m(spark, sf_dir)


@register("lifetime_stats", stage1("SELECT * FROM life"))
def q_lifetime_stats(spark, sf_dir):
    return C.lifetime_stats(_m(spark, sf_dir))


@register("churn_status", stage1("""
SELECT life.customer_id,
       CASE WHEN lost.is_lost THEN 'Churn' ELSE 'Retain' END AS churn_or_retain,
       lost.month_ending AS churn_month,
       CASE WHEN lost.is_lost THEN life.lifetime_months - 1 ELSE life.lifetime_months END AS lifetime_months
FROM life LEFT JOIN lost ON lost.customer_id = life.customer_id"""))
def q_churn_status(spark, sf_dir):
    from ..functions import expressions as X
    m = _m(spark, sf_dir)
    life = C.lifetime_stats(m)
    lost = C.churn_list(m).withColumnRenamed("month_ending", "churn_month")
    j = life.join(lost, "customer_id", "left")
    return j.select("customer_id", X.churn_status("is_lost").alias("churn_or_retain"), "churn_month",
                    X.tenure_months("is_lost", "lifetime_months").alias("lifetime_months"))


@register("starting_mrr", stage1(
    "SELECT month_ending, customer_id, CAST(total_mrr AS DECIMAL(38,2)) AS starting_mrr FROM first_rev"))
def q_starting_mrr(spark, sf_dir):
    src = _src(spark, sf_dir)
    life = C.lifetime_stats(C.active_history(src["mrr_by_location"]))
    s = C.starting_mrr(src["mrr_by_location"], life)
    return s.select("month_ending", "customer_id", F.col("total_mrr").cast("decimal(38,2)").alias("starting_mrr"))


def _bundles(spark, sf_dir):
    src = _src(spark, sf_dir)
    life = C.lifetime_stats(C.active_history(src["mrr_by_location"]))
    return C.first_month_bundles(src["churn_by_product"], life)


@register("starting_bundle", stage1("SELECT * FROM bundle_start"))
def q_starting_bundle(spark, sf_dir):
    return C.starting_bundle(_bundles(spark, sf_dir))


@register("current_bundle", stage1("SELECT * FROM bundle_end"))
def q_current_bundle(spark, sf_dir):
    return C.current_bundle(_bundles(spark, sf_dir))


# --------------------------------------------------------------------- support cases
def _weeks(spark, sf_dir):
    return C.support_case_weeks(_src(spark, sf_dir)["support_interaction_v3"])


@register("support_case_weeks", stage1(
    "SELECT interaction_number, location_id, support_reason, week FROM cases"))
def q_support_case_weeks(spark, sf_dir):
    return _weeks(spark, sf_dir).select("interaction_number", "location_id", "support_reason", "week")


@register("weekly_case_counts", stage1("SELECT * FROM case_weeks"))
def q_weekly_case_counts(spark, sf_dir):
    return C.weekly_case_counts(_weeks(spark, sf_dir))


@register("support_reasons_pivot", stage1("SELECT * FROM reason_counts"))
def q_support_reasons_pivot(spark, sf_dir):
    return C.support_reasons_pivot(_weeks(spark, sf_dir))


# --------------------------------------------------------------------- usage, accounts, cases
@register("first_month_usage", stage1("SELECT * FROM usage_first"))
def q_first_month_usage(spark, sf_dir):
    src = _src(spark, sf_dir)
    m = C.active_history(src["mrr_by_location"])
    return C.first_month_usage(src["location_feature_access_and_usage_by_month"], src["account_v2"], m)


@register("business_segment_tiers", stage1("SELECT * FROM tiers"))
def q_business_segment_tiers(spark, sf_dir):
    return C.business_segments(_src(spark, sf_dir)["account_v2"])


@register("distinct_segments", with_views(
    "SELECT account_id, business_segment_by_hierarchy FROM opportunity_stages_timeline GROUP BY 1, 2",
    "opportunity_stages_timeline"))
def q_distinct_segments(spark, sf_dir):
    return C.distinct_segments(_src(spark, sf_dir)["opportunity_stages_timeline"])


@register("latest_case", stage1("SELECT * FROM last_case"))
def q_latest_case(spark, sf_dir):
    return C.latest_case(_src(spark, sf_dir)["swat_case"])


# --------------------------------------------------------------------- wide row
@register("wide_customer_row", stage1("SELECT * FROM wide", WIDE_CTE))
def q_wide_customer_row(spark, sf_dir):
    return wide_frame(spark, sf_dir).drop(ROW_ID)


@register("swat_for_churned", stage1("""
SELECT CHURN_OR_RETAIN, count(*) AS n_rows, count(SWAT_CASE_ID) AS n_with_case
FROM wide GROUP BY CHURN_OR_RETAIN""", WIDE_CTE))
def q_swat_for_churned(spark, sf_dir):
    w = wide_frame(spark, sf_dir)
    return w.groupBy("CHURN_OR_RETAIN").agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.count("SWAT_CASE_ID").alias("n_with_case"))


@register("coalesce_fallbacks", stage1("""
SELECT DISTINCT LOCATION_ID, PRACTICE_MANAGEMENT_SOFTWARE, INTEGRATIONS FROM wide""", WIDE_CTE))
def q_coalesce_fallbacks(spark, sf_dir):
    w = wide_frame(spark, sf_dir)
    return w.select("LOCATION_ID", "PRACTICE_MANAGEMENT_SOFTWARE", "INTEGRATIONS").distinct()


# --------------------------------------------------------------------- cohort cleaning
@register("cohort_filter", stage1("SELECT * FROM kept", WIDE_CTE, KEPT))
def q_cohort_filter(spark, sf_dir):
    out = C.cohort_filter(wide_frame(spark, sf_dir).drop(ROW_ID), **P)
    return cleaning.complete_rows_ci(out, extract.ID_COLUMNS)


@register("drop_all_null_columns", stage1(
    "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, count({c}) > 0 AS kept FROM kept"
                         for c in C.WIDE_COLUMNS), WIDE_CTE, KEPT))
def q_drop_all_null_columns(spark, sf_dir):
    wide = wide_frame(spark, sf_dir).drop(ROW_ID)
    kept = cleaning.complete_rows_ci(C.cohort_filter(wide, **P), extract.ID_COLUMNS)
    remaining = set(cleaning.drop_all_null_columns(kept).columns)
    # a small (column_name, kept) table derived from the one aggregate job
    return column_catalog(kept).select(
        "column_name", F.col("column_name").isin(*remaining).alias("kept"))


@register("complete_rows", stage1("SELECT * FROM clean", WIDE_CTE, CLEAN))
def q_complete_rows(spark, sf_dir):
    return cohort_frame(spark, sf_dir).drop(ROW_ID)


@register("churn_cohort", stage1("SELECT * FROM clean WHERE CHURN_OR_RETAIN = 'Churn'", WIDE_CTE, CLEAN))
def q_churn_cohort(spark, sf_dir):
    return extract.churn_cohort(cohort_frame(spark, sf_dir)).drop(ROW_ID)
