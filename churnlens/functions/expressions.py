"""Column expressions for the churn pipeline.

Every function returns a built-in ``Column`` expression, so it stays inside
whole-stage codegen: no Python UDF is involved anywhere in this module.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Thresholds, labels and patterns that must equal the original
# pipeline's for identical results.
# ---------------------------------------------------------------------------
TIER_SINGLE, TIER_MULTI, TIER_MID, TIER_ENTERPRISE = "Single", "Multi", "Mid Market", "Enterprise"
CHURN, RETAIN = "Churn", "Retain"
ACTIVATION_CUT = 9
EOD_PMS_PATTERN = r"(Eaglesoft|Open\s*Dental|Dentrix\s*(G5\+?|G6(?:\.2-7)?|G7))"
EOD_LABEL, OTHER_PMS_LABEL = "EOD pms", "Others"
CORE_BUNDLE, PLUS_BUNDLE, OTHER_BUNDLE = "core bundle", "plus bundle", "other"
REASON_PATTERNS = {
    "reason_billing": "%Billing%",
    "reason_phone_system": "%Phone System%",
    "reason_data_sync": "%Data Sync%",
}
UNKNOWN = "Unknown"
MISSING_TEXT = ("", "nan", "None")
# Product-family tokens are deployment data (the vendor's bundle names), so
# they are parameters; these neutral defaults match any "...Core" / "...Plus".
DEFAULT_CORE_TOKEN, DEFAULT_PLUS_TOKEN = "Core", "Plus"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hierarchy_tier(n: str | Column) -> Column:
    """1 -> Single, <10 -> Multi (0 and negatives too), <50 -> Mid Market, else Enterprise."""
    n = _c(n)
    return (F.when(n == 1, TIER_SINGLE).when(n < 10, TIER_MULTI)
            .when(n < 50, TIER_MID).when(n >= 50, TIER_ENTERPRISE))


def churn_status(is_lost: str | Column) -> Column:
    """'Churn' when the lost flag is true; false or null -> 'Retain'."""
    return F.when(_c(is_lost), F.lit(CHURN)).otherwise(F.lit(RETAIN))


def tenure_months(is_lost: str | Column, months: str | Column) -> Column:
    """A lost customer's final (cancellation) month does not count as tenure."""
    return F.when(_c(is_lost), _c(months) - 1).otherwise(_c(months))


def week_number(start: str | Column, created: str | Column) -> Column:
    """floor(days between the two dates / 7); days 0-6 are week 0, negatives floor down."""
    return F.floor(F.datediff(F.to_date(_c(created)), F.to_date(_c(start))) / 7)


def month_index(d: str | Column) -> Column:
    d = _c(d)
    return F.year(d) * 12 + F.month(d)


def month_gap(start: str | Column, end: str | Column) -> Column:
    """Calendar-month boundaries crossed from ``start`` to ``end`` (month-truncated)."""
    return month_index(F.trunc(_c(end), "MM")) - month_index(F.trunc(_c(start), "MM"))


def ilike_count(text: str | Column, pattern: str) -> Column:
    """1 when text ILIKE pattern, else 0 (null text counts 0)."""
    return F.when(_c(text).ilike(pattern), 1).otherwise(0)


def contains_ci(text: str | Column, token: str) -> Column:
    """Case-insensitive substring test, null -> false."""
    return F.coalesce(F.lower(_c(text)).contains(token.lower()), F.lit(False))


def bundle_type(bundle: str | Column, core_token: str = DEFAULT_CORE_TOKEN,
                plus_token: str = DEFAULT_PLUS_TOKEN) -> Column:
    """Ordered choice: core wins over plus; null or neither -> other."""
    return (F.when(contains_ci(bundle, core_token), CORE_BUNDLE)
            .when(contains_ci(bundle, plus_token), PLUS_BUNDLE)
            .otherwise(OTHER_BUNDLE))


def _text(col: str | Column, null_as_text: bool) -> Column:
    s = F.trim(_c(col))
    # The original casts null to the string 'nan' before comparing with ''.
    return F.coalesce(s, F.lit("nan")) if null_as_text else F.coalesce(s, F.lit(""))


def pms_lookup(integrations: str | Column | None, pms: str | Column | None,
               null_as_text: bool = False) -> Column:
    """Integration text unless blank, else the practice-management text."""
    integ = _text(integrations, null_as_text) if integrations is not None else F.lit("")
    pm = _text(pms, null_as_text) if pms is not None else F.lit("")
    return F.when(integ != "", integ).otherwise(pm)


def pms_group(lookup: str | Column, pattern: str = EOD_PMS_PATTERN) -> Column:
    """'EOD pms' when the lookup text matches the pattern (case-insensitive)."""
    hit = F.coalesce(_c(lookup).rlike("(?i)" + pattern), F.lit(False))
    return F.when(hit, EOD_LABEL).otherwise(OTHER_PMS_LABEL)


def activation_flag(count: str | Column, cut: int = ACTIVATION_CUT) -> Column:
    """1 when count > cut (a null count compares false -> 0)."""
    return F.coalesce((_c(count) > cut).cast("int"), F.lit(0))


def positive_flag(count: str | Column) -> Column:
    """1 when count > 0; null -> 0."""
    return F.coalesce((_c(count) > 0).cast("int"), F.lit(0))


def churn_label(status: str | Column) -> Column:
    """Churn -> 1, Retain -> 0, anything else -> null."""
    s = _c(status)
    return F.when(s == CHURN, 1).when(s == RETAIN, 0).cast("int")


def finite_or_null(x: str | Column) -> Column:
    """NaN and +/-inf become null (Spark keeps NaN distinct from null)."""
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def strip_ws(text: str | Column) -> Column:
    """Strip leading/trailing whitespace of every kind (SQL trim only strips spaces)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def text_or_unknown(text: str | Column) -> Column:
    """Stripped text; empty, 'nan', 'None' or null -> 'Unknown'."""
    s = strip_ws(_c(text).cast("string"))
    return F.when(s.isNull() | s.isin(*MISSING_TEXT), F.lit(UNKNOWN)).otherwise(s)


def blank_to_null(text: str | Column) -> Column:
    s = strip_ws(_c(text).cast("string"))
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def coefficient_interpretation(coef: str | Column) -> Column:
    return F.when(_c(coef) > 0, "Increases churn risk").otherwise("Decreases churn risk")
