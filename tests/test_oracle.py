"""Spark queries against their DuckDB oracles on the smallest driver tables.

The full set runs at sf0.01 through ``tests/oracle_harness.py``; here a
representative query of every stage is checked inside pytest.  Fitted-model
queries are left out: the sf0.001 cohort holds churned rows only.
"""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test tables not present")

NAMES = [
    "scan_sources", "active_history", "lifetime_stats", "starting_bundle", "weekly_case_counts",
    "support_reasons_pivot", "first_month_usage", "latest_case", "wide_customer_row", "complete_rows",
    "standardise_columns", "feature_rows", "feature_vector", "stratified_split", "coefficient_scores",
    "risk_ranked_accounts", "probability_summary", "risk_histogram", "churn_by_industry",
    "segment_input", "compose_profile_text", "industry_markdown", "top_values_pct", "pain_point_themes",
    "industry_profiles", "csv_roundtrip", "lifetime_stats_sql",
]


@pytest.fixture(scope="module")
def oracle():
    import __spark_entry__ as E
    from oracle_harness import duck
    return E.queries(), E.oracle_sql(), duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, oracle, name):
    from oracle_harness import compare
    qs, sqls, con = oracle
    res = compare(spark, SF, name, qs[name], sqls[name], con)
    assert res["status"] == "match", res
