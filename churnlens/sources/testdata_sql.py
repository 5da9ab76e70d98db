"""DuckDB text of the logical source tables in ``testdata`` (oracle side).

``with_views(body, *names)`` prefixes a query with the CTEs it needs.  The
expression constants are imported from ``testdata`` so both engines evaluate
identical text.
"""

from __future__ import annotations

from .testdata import (BILLING_START_FROM, INDUSTRY, INTEGRATION, LOCATIONS_ACTIVE,
                       LOCATIONS_TOTAL, MONTH_END, OPPORTUNITY_SEGMENT, PMS, PRODUCT_FAMILY, PRODUCT_NAME,
                       SUPPORT_PRIMARY, USAGE_AGGS)

_usage_cols = ",\n  ".join(f"{e} AS {n}" for n, e in USAGE_AGGS.items())

VIEWS: dict[str, str] = {
    "mrr_by_location": f"""
SELECT customer_id, month_ending, CAST(total AS DECIMAL(18,2)) AS total_mrr,
       (urgent = 1 OR month_ending = MIN(month_ending) OVER (PARTITION BY customer_id)) AS is_new,
       (pending = 1 AND month_ending = MAX(month_ending) OVER (PARTITION BY customer_id)) AS is_lost
FROM (SELECT o_custkey AS customer_id, {MONTH_END} AS month_ending,
             SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total,
             MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent,
             MAX(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS pending
      FROM orders GROUP BY 1, 2) om""",
    "churn_by_product": f"""
SELECT DISTINCT o_custkey AS finance_id, {MONTH_END} AS month_ending,
       {PRODUCT_NAME} AS product_name, {PRODUCT_FAMILY} AS product_family
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "support_interaction_v3": f"""
SELECT ts AS created_at, event_id AS interaction_number, user_id AS location_id,
       {BILLING_START_FROM.format(key='user_id')} AS billing_start_date,
       {SUPPORT_PRIMARY} AS "primary", event_type AS reason_topic, props AS subject
FROM events""",
    "account_v2": f"""
SELECT c_custkey AS location_id, c_custkey AS finance_number, c_name AS slug,
       {LOCATIONS_ACTIVE} AS number_of_locations_in_hierarchy_active,
       {LOCATIONS_TOTAL} AS number_of_locations_in_hierarchy_total,
       c_custkey % 60 > 1 AS is_parent_account,
       {BILLING_START_FROM.format(key='c_custkey')} AS billing_start_date,
       {BILLING_START_FROM.format(key='c_custkey')} + 14 AS onboarding_handoff
FROM customer""",
    "location_feature_access_and_usage_by_month": f"""
SELECT o_custkey AS location_id, {MONTH_END} AS report_month,
  {_usage_cols}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY 1, 2""",
    "stg_location_integrations": f"""
SELECT c_custkey AS location_id, {INTEGRATION} AS integrations
FROM customer WHERE c_custkey % 2 = 1""",
    "swat_case": """
SELECT e.user_id AS location_id, e.event_id AS case_id,
       CASE WHEN e.value >= 50 THEN 'Closed' ELSE 'Open' END AS case_status,
       CAST(e.ts AS DATE) AS created_date, d.text AS cancel_summary,
       CASE WHEN e.value >= 50 THEN 'Price' ELSE 'Product' END AS cancellation_reason,
       e.props AS cancellation_subreason
FROM events e
LEFT JOIN documents d ON e.event_id % (SELECT COUNT(*) FROM documents) = d.doc_id
WHERE e.event_type = 'error'""",
    "location": f"""
SELECT c_name AS slug, c_custkey AS finance_id, c_custkey AS location_id, c_name AS location_name,
       {INDUSTRY} AS core_industry, c_mktsegment AS core_sub_industry, n_name AS specialty,
       CASE WHEN c_custkey % 7 = 0 THEN 'Satellite' ELSE 'Primary' END AS location_type,
       {PMS} AS practice_management_software, c_custkey % 7 = 0 AS is_satellite
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "opportunity_stages_timeline": f"""
SELECT o_custkey AS account_id, {OPPORTUNITY_SEGMENT} AS business_segment_by_hierarchy
FROM orders""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named logical views as CTEs (DuckDB dialect)."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
