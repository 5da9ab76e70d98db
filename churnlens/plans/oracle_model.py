"""DuckDB oracle text for the stage-2 (features, split, fitted statistics, scoring) queries.

Built on the stage-1 ``clean`` CTE with upper-case warehouse names; the
feature logic is restated in SQL rather than generated from the Spark code.
"""

from __future__ import annotations

from ..functions import expressions as X
from ..operators.features import MODEL_FEATURES
from ..operators.modeling import RISK_MULTIPLIERS, SPLIT_SALT
from .oracle_cohort import WIDE_CTE, cohort_clean_cte, stage1
from .registry import TESTDATA_PARAMS

P = TESTDATA_PARAMS
LO, HI = P["churn_range"]
CLEAN = cohort_clean_cte(P["retain_min"], LO, HI, P["since"])

_row_key = ["CAST(LOCATION_ID AS VARCHAR)", "CAST(CHURN_MONTH AS VARCHAR)", "STARTING_BUNDLE",
            "END_BUNDLE", "CAST(SWAT_CASE_ID AS VARCHAR)", "CAST(FIRST_USAGE_REPORT_MONTH AS VARCHAR)"]
ROW_ID_SQL = "md5(concat_ws('|', " + ", ".join(f"coalesce({k}, '')" for k in _row_key) + "))"

_usage_upper = {"Inbound Sms Count": "FIRST_INBOUND_SMS_COUNT",
                "Outbound Sms Count": "FIRST_OUTBOUND_SMS_COUNT",
                "Automated Sms Sent Count": "FIRST_AUTOMATED_SMS_COUNT",
                "Manual Messages Sms Count": "FIRST_MISSED_TEXT_SMS_COUNT",
                "Inbound Call Count": "FIRST_INBOUND_CALL_COUNT",
                "Outbound Call Count": "FIRST_OUTBOUND_CALL_COUNT"}
_usage_nn = " AND ".join(f"{u} IS NOT NULL" for u in _usage_upper.values())
_lookup = ("CASE WHEN coalesce(trim(INTEGRATIONS), '') <> '' THEN trim(INTEGRATIONS) "
           "ELSE coalesce(trim(PRACTICE_MANAGEMENT_SOFTWARE), '') END")

ENRICHED_CTE = f"""
enr AS (
  SELECT c.*, {ROW_ID_SQL} AS row_id,
    CASE WHEN strpos(lower(STARTING_BUNDLE), lower('{X.DEFAULT_CORE_TOKEN}')) > 0 THEN '{X.CORE_BUNDLE}'
         WHEN strpos(lower(STARTING_BUNDLE), lower('{X.DEFAULT_PLUS_TOKEN}')) > 0 THEN '{X.PLUS_BUNDLE}'
         ELSE '{X.OTHER_BUNDLE}' END AS bundle_type,
    coalesce(WEEK_1_CASES, 0) + coalesce(WEEK_2_CASES, 0) + coalesce(WEEK_3_CASES, 0)
      + coalesce(WEEK_4_CASES, 0) AS first_month_swat_cases,
    CASE WHEN coalesce(regexp_matches({_lookup}, '(?i){X.EOD_PMS_PATTERN}'), false)
         THEN '{X.EOD_LABEL}' ELSE '{X.OTHER_PMS_LABEL}' END AS pms_group
  FROM clean c
  WHERE lower(trim(BUSINESS_SEGMENT_BY_HIERARCHY_ACTIVE)) = 'single'
    AND (CHURN_OR_RETAIN = 'Retain' OR (CHURN_OR_RETAIN = 'Churn' AND LIFETIME_MONTHS BETWEEN {LO} AND {HI}))
    AND {_usage_nn}
    AND CORE_INDUSTRY IS NOT NULL AND STARTING_BUNDLE IS NOT NULL
    AND NOT (coalesce(trim(PRACTICE_MANAGEMENT_SOFTWARE) = '', true)
             AND coalesce(trim(INTEGRATIONS) = '', true))
)"""

_act = {f"{h} Activated": f"coalesce(CAST({u} > 9 AS INTEGER), 0)" for h, u in _usage_upper.items()}
_feature_sql = {
    "Core Industry_Medical": "CASE WHEN CORE_INDUSTRY = 'Medical' THEN 1 ELSE 0 END",
    "BundleType_core bundle": f"CASE WHEN bundle_type = '{X.CORE_BUNDLE}' THEN 1 ELSE 0 END",
    "Week 1 Cases": "WEEK_1_CASES", "Week 2 Cases": "WEEK_2_CASES",
    "Week 3 Cases": "WEEK_3_CASES", "Week 4 Cases": "WEEK_4_CASES",
    **_act,
    "Reason Billing Flag": "coalesce(CAST(REASON_BILLING > 0 AS INTEGER), 0)",
    "Reason Phone System Flag": "coalesce(CAST(REASON_PHONE_SYSTEM > 0 AS INTEGER), 0)",
    "Reason Data Sync Flag": "coalesce(CAST(REASON_DATA_SYNC > 0 AS INTEGER), 0)",
    "PMS_Group_EOD pms": f"CASE WHEN pms_group = '{X.EOD_LABEL}' THEN 1 ELSE 0 END",
}
FEATURE_SQL = _feature_sql
_mdl_cols = ",\n    ".join(f'CAST({_feature_sql[f]} AS DOUBLE) AS "{f}"' for f in MODEL_FEATURES)
_extra = ",\n    ".join(f'{e} AS "{n}"' for n, e in _act.items()
                       if n not in MODEL_FEATURES)

# Per class: test = round(0.2 n), val = round(0.25 (n - test)), halves up, in integers.
MODEL_CTE = f"""
mdl0 AS (
  SELECT row_id,
    {_mdl_cols},
    {_extra},
    CASE CHURN_OR_RETAIN WHEN 'Churn' THEN 1 WHEN 'Retain' THEN 0 END AS churn_flag,
    CORE_INDUSTRY AS "Core Industry", bundle_type AS "BundleType",
    CAST(LIFETIME_MONTHS AS DOUBLE) AS tenure, CAST(LIFETIME_VALUE AS DOUBLE) AS revenue,
    CAST(STARTING_MRR AS DOUBLE) AS starting_mrr,
    md5(row_id || '|{SPLIT_SALT}') AS _sh
  FROM enr
),
mdl AS (
  SELECT * EXCLUDE (_sh, _rn, _nc, _nt),
    CASE WHEN _rn <= _nt THEN 'test' WHEN _rn <= _nt + (2 * (_nc - _nt) + 4) // 8 THEN 'val'
         ELSE 'train' END AS split
  FROM (SELECT *, (2 * _nc + 5) // 10 AS _nt
        FROM (SELECT *, row_number() OVER (PARTITION BY churn_flag ORDER BY _sh, row_id) AS _rn,
                     count(*) OVER (PARTITION BY churn_flag) AS _nc FROM mdl0) a) b
)"""


def stage2(body: str, *extra: str) -> str:
    return stage1(body, WIDE_CTE, CLEAN, ENRICHED_CTE, MODEL_CTE, *extra)


# ---------------------------------------------------------------- published-coefficient scores
def coefficient_score_sql(coefs: dict[str, float]) -> str:
    z = f"({coefs['const']!r}" + "".join(f' + ({v!r}) * "{k}"' for k, v in coefs.items() if k != "const") + ")"
    return f"1.0 / (1.0 + exp(-{z}))"


def risk_sql(p: str) -> str:
    expr = p
    for c, k in RISK_MULTIPLIERS:
        expr = f'{expr} * (1.0 + ({k!r}) * CAST(coalesce("{c}", 0) AS INTEGER))'
    return f"greatest(least({expr}, 1.0), 0.0)"
