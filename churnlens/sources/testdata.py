"""Adapter: driver test tables -> the nine logical source tables of the churn pipeline.

The driver ships TPC-H-style parquet tables.  The pipeline reads a revenue
history, a product history, support interactions, accounts, monthly usage,
integrations, cancellation cases and a location master.  Each logical table
below is a deterministic projection of the driver tables, written once as
SQL expression text that both Spark (``F.expr``) and DuckDB accept, so the
oracle in ``__spark_entry__`` sees the very same inputs.

All joins here are equi-joins on keys; no table is collected or broadcast by
hand (AQE picks broadcast only from measured sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# ---------------------------------------------------------------------------
# Shared expression text (valid in Spark SQL and DuckDB)
# ---------------------------------------------------------------------------
MONTH_END = "last_day(CAST(o_orderdate AS DATE))"
BILLING_START_FROM = "DATE '2023-12-20' + CAST({key} % 20 AS INTEGER)"
INDUSTRY = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Dental' WHEN 'BUILDING' THEN 'Medical' "
            "WHEN 'FURNITURE' THEN 'Veterinary' WHEN 'HOUSEHOLD' THEN 'Optometry' "
            "ELSE 'Chiropractic' END")
PMS = ("CASE c_nationkey % 6 WHEN 0 THEN 'Eaglesoft' WHEN 1 THEN 'Open Dental' "
       "WHEN 2 THEN 'Dentrix G6.2-7' WHEN 3 THEN 'Dentrix' WHEN 4 THEN 'OpenDental Cloud' "
       "ELSE 'Avimark' END")
INTEGRATION = ("CASE c_custkey % 6 WHEN 1 THEN 'Eaglesoft' WHEN 3 THEN '' "
               "ELSE 'Denticon' END")
LOCATIONS_ACTIVE = ("CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 < 7 THEN 1 "
                    "ELSE CAST(c_custkey % 60 AS INTEGER) END")
LOCATIONS_TOTAL = "CAST(c_custkey % 60 AS INTEGER)"
PRODUCT_NAME = ("CASE WHEN p_type = 'PROMO' THEN 'Core - ' || p_brand "
                "WHEN p_size <= 25 THEN 'Plus - ' || p_brand "
                "ELSE 'Essentials - ' || p_brand END")
PRODUCT_FAMILY = ("CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'Core Products' "
                  "ELSE 'Add-ons' END")
# Only the costlier error / purchase events become data-sync / billing
# cases, so the reason flags vary between locations.
SUPPORT_PRIMARY = ("CASE WHEN event_type = 'error' AND value >= 100 THEN 'Data Sync failure' "
                   "WHEN event_type = 'purchase' AND value >= 120 THEN 'Billing question' "
                   "WHEN event_type = 'signup' THEN 'Phone System setup' "
                   "WHEN event_type = 'click' THEN 'General' END")


OPPORTUNITY_SEGMENT = ("CASE WHEN o_totalprice < 100000 THEN 'Single' "
                       "WHEN o_totalprice < 300000 THEN 'Multi' ELSE 'Mid Market' END")


def _qty_when(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN l_quantity ELSE 0 END) AS BIGINT)"


USAGE_AGGS = {
    "inbound_sms_count": _qty_when("l_returnflag = 'A'"),
    "outbound_sms_count": _qty_when("l_returnflag = 'N'"),
    "inbound_call_count": _qty_when("l_returnflag = 'R'"),
    "outbound_call_count": _qty_when("l_linestatus = 'F'"),
    "missed_call_sms_count": _qty_when("l_linestatus = 'O'"),
    "missed_text_sms_count": "COUNT(*)",
    "automated_sms_sent_count": "CAST(SUM(l_linenumber) AS BIGINT)",
    "has_appointment_reminders": "MAX(l_discount) > 0.05",
    "has_missed_call_text": "MAX(l_tax) > 0.04",
    "has_missed_text_text": "MAX(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1",
}

# The same in two steps, per order and then per month: (the order's value, how a month joins its orders' values)
USAGE_STEPS = {
    **{n: (text.removeprefix("CAST(").removesuffix(" AS BIGINT)"), "CAST(SUM({}) AS BIGINT)")
       for n, text in USAGE_AGGS.items() if text.startswith("CAST(SUM(")},
    "missed_text_sms_count": ("COUNT(*)", "SUM({})"),
    "has_appointment_reminders": ("MAX(l_discount)", "MAX({}) > 0.05"),
    "has_missed_call_text": ("MAX(l_tax)", "MAX({}) > 0.04"),
    "has_missed_text_text": ("MAX(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)", "MAX({}) = 1"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _x(text: str, alias: str):
    return F.expr(text).alias(alias)


def mrr_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders travel once, to their customer: months, their bounds and what readers do per customer stay there."""
    orders = read_table(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL").select(
        F.col("o_custkey").alias("customer_id"), _x(MONTH_END, "month_ending"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        _x("CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END", "urgent"), _x("CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END", "pending"))
    monthly = orders.repartition("customer_id").groupBy("customer_id", "month_ending").agg(
        F.sum("price").alias("total"), F.max("urgent").alias("urgent"), F.max("pending").alias("pending"))
    months = Window.partitionBy("customer_id")  # a customer has one row a month
    return (
        monthly
        .withColumns({"first_m": F.min("month_ending").over(months), "last_m": F.max("month_ending").over(months)})
        .select("customer_id", "month_ending",
                F.col("total").cast("decimal(18,2)").alias("total_mrr"),
                F.expr("urgent = 1 OR month_ending = first_m").alias("is_new"),
                F.expr("pending = 1 AND month_ending = last_m").alias("is_lost"))
    )


def _orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _x(MONTH_END, "month_ending"))


def churn_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts come first, so a reader's filter on the family holds before lines meet their orders.

    Duplicates go within (customer, month), which is also how readers join.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = _orders_by_month(spark, sf_dir)
    part = read_table(spark, sf_dir, "part").select("p_partkey", _x(PRODUCT_NAME, "product_name"), _x(PRODUCT_FAMILY, "product_family"))
    return (
        li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", "product_name", "product_family")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("finance_id"), "month_ending", "product_name", "product_family")
        .repartition("finance_id", "month_ending").distinct()
    )


def support_interaction_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("ts").alias("created_at"), F.col("event_id").alias("interaction_number"),
        F.col("user_id").alias("location_id"),
        _x(BILLING_START_FROM.format(key="user_id"), "billing_start_date"),
        _x(SUPPORT_PRIMARY, "primary"), F.col("event_type").alias("reason_topic"),
        F.col("props").alias("subject"))


def account_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("location_id"), F.col("c_custkey").alias("finance_number"),
        F.col("c_name").alias("slug"),
        _x(LOCATIONS_ACTIVE, "number_of_locations_in_hierarchy_active"),
        _x(LOCATIONS_TOTAL, "number_of_locations_in_hierarchy_total"),
        _x("c_custkey % 60 > 1", "is_parent_account"),
        _x(BILLING_START_FROM.format(key="c_custkey"), "billing_start_date"),
        _x(BILLING_START_FROM.format(key="c_custkey") + " + 14", "onboarding_handoff"))


def location_usage_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are added up per order before they meet it; orders travel once, to their location."""
    per_order = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[_x(USAGE_STEPS[n][0], n) for n in USAGE_AGGS])
    orders = _orders_by_month(spark, sf_dir)
    return (
        per_order.join(orders, per_order.l_orderkey == orders.o_orderkey)
        .withColumnsRenamed({"o_custkey": "location_id", "month_ending": "report_month"}).repartition("location_id")
        .groupBy("location_id", "report_month").agg(*[_x(USAGE_STEPS[n][1].format(n), n) for n in USAGE_AGGS])
    )


def location_integrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("location_id"),
                                                 _x(INTEGRATION, "integrations"))


def swat_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").filter("event_type = 'error'")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.select(F.count("*")).scalar()
    return (
        ev.join(docs, (ev.event_id % n_docs) == docs.doc_id, "left")
        .select(F.col("user_id").alias("location_id"), F.col("event_id").alias("case_id"),
                _x("CASE WHEN value >= 50 THEN 'Closed' ELSE 'Open' END", "case_status"),
                _x("CAST(ts AS DATE)", "created_date"),
                F.col("text").alias("cancel_summary"),
                _x("CASE WHEN value >= 50 THEN 'Price' ELSE 'Product' END", "cancellation_reason"),
                F.col("props").alias("cancellation_subreason"))
    )


def location_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey, "left")
        .select(F.col("c_name").alias("slug"), F.col("c_custkey").alias("finance_id"),
                F.col("c_custkey").alias("location_id"), F.col("c_name").alias("location_name"),
                _x(INDUSTRY, "core_industry"), F.col("c_mktsegment").alias("core_sub_industry"),
                F.col("n_name").alias("specialty"),
                _x("CASE WHEN c_custkey % 7 = 0 THEN 'Satellite' ELSE 'Primary' END", "location_type"),
                _x(PMS, "practice_management_software"),
                _x("c_custkey % 7 = 0", "is_satellite"))
    )


def opportunity_stages_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("account_id"),
                         _x(OPPORTUNITY_SEGMENT, "business_segment_by_hierarchy"))


def load_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All nine logical source tables, lazily defined (nothing is computed here)."""
    return {
        "mrr_by_location": mrr_by_location(spark, sf_dir),
        "churn_by_product": churn_by_product(spark, sf_dir),
        "support_interaction_v3": support_interaction_v3(spark, sf_dir),
        "account_v2": account_v2(spark, sf_dir),
        "location_feature_access_and_usage_by_month": location_usage_by_month(spark, sf_dir),
        "stg_location_integrations": location_integrations(spark, sf_dir),
        "swat_case": swat_case(spark, sf_dir),
        "location": location_master(spark, sf_dir),
        "opportunity_stages_timeline": opportunity_stages_timeline(spark, sf_dir),
    }
