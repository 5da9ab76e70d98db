"""Single feature steps, and the parity modes, on adapter rows that reach every branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import cleaning, cohort as C
from ..operators import features as FE
from ..operators import modeling as MO
from ..operators.cleaning import q
from ..sources.testdata import INTEGRATION, PMS, load_sources, read_table
from .oracle_cohort import WIDE_CTE, stage1
from .oracle_model import risk_sql, stage2
from .queries_cohort import cohort_frame
from .queries_model import enriched_and_model, model_rows
from .registry import register

# customers whose software or integration is null, blank or given, in every combination
TEXT_VIEW = f"""
txt AS (
  SELECT c_custkey AS id,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN ' ' ELSE {PMS} END AS pms,
    CASE WHEN c_custkey % 7 < 2 THEN NULL WHEN c_custkey % 7 = 2 THEN '' ELSE {INTEGRATION} END AS integration
  FROM customer)"""


def _texts(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"),
                    F.expr(f"CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN ' ' ELSE {PMS} END").alias("pms"),
                    F.expr(f"CASE WHEN c_custkey % 7 < 2 THEN NULL WHEN c_custkey % 7 = 2 THEN '' ELSE {INTEGRATION} END").alias("integration"))


@register("drop_missing_both", f"WITH {TEXT_VIEW}" + """
SELECT id, 'intent' AS mode FROM txt WHERE trim(ifnull(pms, '')) <> '' OR trim(ifnull(integration, '')) <> ''
UNION ALL SELECT id, 'parity' FROM txt WHERE trim(ifnull(pms, 'nan')) <> '' OR trim(ifnull(integration, 'nan')) <> ''""")
def q_drop_missing_both(spark, sf_dir):
    """Rows kept by intent (null is blank) and in parity mode (null is the text 'nan')."""
    t = _texts(spark, sf_dir)
    kept = [cleaning.drop_missing_both(t, "pms", "integration", null_as_text=parity).select("id", F.lit(mode).alias("mode"))
            for mode, parity in (("intent", False), ("parity", True))]
    return kept[0].unionByName(kept[1])


_EOD = f"regexp_matches({{}}, '(?i){X.EOD_PMS_PATTERN}')"


@register("pms_group", f"WITH {TEXT_VIEW}" + f"""
SELECT id, CASE WHEN {_EOD.format("if(trim(ifnull(integration, '')) <> '', trim(integration), trim(ifnull(pms, '')))")}
           THEN '{X.EOD_LABEL}' ELSE '{X.OTHER_PMS_LABEL}' END AS intent,
  CASE WHEN {_EOD.format("if(trim(ifnull(integration, 'nan')) <> '', trim(ifnull(integration, 'nan')), trim(ifnull(pms, 'nan')))")}
       THEN '{X.EOD_LABEL}' ELSE '{X.OTHER_PMS_LABEL}' END AS parity FROM txt""")
def q_pms_group(spark, sf_dir):
    """Software group by intent and in parity mode."""
    t = _texts(spark, sf_dir)
    return t.select("id", *[X.pms_group(X.pms_lookup(F.col("integration"), F.col("pms"), null_as_text=p)).alias(n)
                            for n, p in (("intent", False), ("parity", True))])


@register("clean_features", """
SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber NOT IN (1, 2, 3) THEN CAST(l_discount AS DOUBLE) END AS x,
       CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS INTEGER) AS y
FROM lineitem WHERE l_returnflag IN ('A', 'N')""")
def q_clean_features(spark, sf_dir):
    """Infinities and NaN become null, rows without a label go."""
    li = read_table(spark, sf_dir, "lineitem")
    x = (F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).when(F.col("l_linenumber") == 2, F.lit(float("-inf")))
         .when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount").cast("double")))
    status = F.when(F.col("l_returnflag") == "A", X.CHURN).when(F.col("l_returnflag") == "N", X.RETAIN).otherwise("other")
    rows = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), x.alias("x"), status.alias(FE.STATUS))
    rows = FE.model_frame(rows, levels={})
    return rows.select("id", "line", X.finite_or_null("x").alias("x"), F.col(FE.LABEL).alias("y"))


@register("single_location_filter", stage2(
    "SELECT LOCATION_ID FROM clean WHERE lower(trim(BUSINESS_SEGMENT_BY_HIERARCHY_ACTIVE)) = 'single'"))
def q_single_location_filter(spark, sf_dir):
    return FE.single_location_filter(cohort_frame(spark, sf_dir)).select("LOCATION_ID")


@register("first_month_cases", stage2(
    'SELECT row_id, first_month_swat_cases AS skip_null, WEEK_1_CASES + WEEK_2_CASES + WEEK_3_CASES + WEEK_4_CASES AS notebook FROM enr'))
def q_first_month_cases(spark, sf_dir):
    enr, _ = enriched_and_model(spark, sf_dir)
    return enr.select(FE.ROW_ID, FE.first_month_cases(enr).alias("skip_null"), FE.first_month_cases(enr, skip_null=False).alias("notebook"))


@register("bundle_type", stage1("""
SELECT finance_id, product_name, CASE WHEN contains(lower(product_name), 'core') THEN 'core bundle'
       WHEN contains(lower(product_name), 'plus') THEN 'plus bundle' ELSE 'other' END AS bundle_type FROM churn_by_product"""))
def q_bundle_type(spark, sf_dir):
    p = load_sources(spark, sf_dir)["churn_by_product"]
    return p.select("finance_id", "product_name", X.bundle_type("product_name").alias("bundle_type"))


@register("churn_label", stage1("""
SELECT LOCATION_ID, CASE CHURN_OR_RETAIN WHEN 'Churn' THEN 1 WHEN 'Retain' THEN 0 END AS label FROM wide""", WIDE_CTE))
def q_churn_label(spark, sf_dir):
    from .queries_cohort import wide_frame
    return wide_frame(spark, sf_dir).select("LOCATION_ID", X.churn_label("CHURN_OR_RETAIN").alias("label"))


@register("business_risk_index", stage2(f"SELECT row_id, round({risk_sql('CAST(0.5 AS DOUBLE)')}, 12) AS risk_at_half FROM mdl"))
def q_business_risk_index(spark, sf_dir):
    """The risk factors alone: every row at probability one half."""
    m = model_rows(spark, sf_dir).withColumn("p", F.lit(0.5))
    return m.select(FE.ROW_ID, F.round(MO.business_risk_index(m, "p"), 12).alias("risk_at_half"))


@register("nonnull_of_every_column", stage2(
    "SELECT CHURN_OR_RETAIN AS status, " + ", ".join(f"count({c}) AS {c}" for c in C.WIDE_COLUMNS) + " FROM wide GROUP BY 1"))
def q_nonnull_of_every_column(spark, sf_dir):
    """Non-null count of every column by label."""
    from .queries_cohort import wide_frame
    w = wide_frame(spark, sf_dir)
    return w.groupBy(F.col("CHURN_OR_RETAIN").alias("status")).agg(*[F.count(q(c)).alias(c) for c in C.WIDE_COLUMNS])


@register("cases_by_account_rows", stage1("""
SELECT s.location_id, s.interaction_number FROM support_interaction_v3 s
JOIN account_v2 a ON a.location_id = s.location_id
UNION ALL SELECT location_id, interaction_number FROM support_interaction_v3
WHERE location_id IS NOT NULL AND location_id NOT IN (SELECT location_id FROM account_v2 WHERE location_id IS NOT NULL)"""))
def q_cases_by_account_rows(spark, sf_dir):
    """Parity: support cases repeated once per account row of their location."""
    src = load_sources(spark, sf_dir)
    return C.support_case_weeks(src["support_interaction_v3"], src["account_v2"]).select("location_id", "interaction_number")


@register("bundles_of_any_month", stage1("""
SELECT month_ending, finance_id, product_name FROM churn_by_product
WHERE product_family = 'Core Products' AND finance_id IN (SELECT customer_id FROM life)"""))
def q_bundles_of_any_month(spark, sf_dir):
    """Intent variant of the bundle history: core products of every month, not only the first."""
    src = load_sources(spark, sf_dir)
    life = C.lifetime_stats(C.active_history(src["mrr_by_location"]))
    return C.first_month_bundles(src["churn_by_product"], life, restrict_first_month=False)
