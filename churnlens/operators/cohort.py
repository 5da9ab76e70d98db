"""Stage 1: one wide row per location from revenue, product, support, usage and case history.

Patterns of the form "keep rows whose value equals the max/min over the key"
are a partial aggregate plus a semi-join instead of a window, so the aggregate
is combined map-side.  Where such a key can hold a large share of the rows, the
aggregate is written first (``cut_lineage``): the join then has a shuffle stage
on both sides, which is what AQE's skew handling needs to split a hot key.  An
aggregate joined directly has no shuffle of its own and could not be split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import expressions as X
from ..session import at_once, cut_lineage
from .features import add_row_id

CORE_FAMILY = "Core Products"  # fixed value: product family kept for bundles
CASE_WEEKS = tuple(range(1, 13))
ROWS_IN_PLACE = 1_000_000  # wide rows of one location that one task may number
REASON_WEEKS = (1, 2, 3, 4)
USAGE_COLUMNS = ("inbound_sms_count", "outbound_sms_count", "inbound_call_count",
                 "outbound_call_count", "missed_call_sms_count", "missed_text_sms_count",
                 "automated_sms_sent_count", "has_appointment_reminders",
                 "has_missed_call_text", "has_missed_text_text")


def keep_extreme(df: DataFrame, keys: Sequence[str], col: str, how: str = "max") -> DataFrame:
    """Rows whose ``col`` equals the per-key max (or min); ties are all kept, nulls dropped."""
    agg = F.max(col) if how == "max" else F.min(col)
    best = df.groupBy(*keys).agg(agg.alias(col))
    return df.join(best, on=[*keys, col], how="left_semi")


# --------------------------------------------------------------------------- revenue
def active_history(mrr: DataFrame, customer: str = "customer_id", month: str = "month_ending",
                   new_flag: str = "is_new") -> DataFrame:
    """History from each customer's last (re)start month on; never-new customers drop out.

    A history has a row per customer and month, so the last start is a window
    over a customer's few rows: the history is built once and shuffled once.
    """
    last_new = F.max(F.when(F.col(new_flag), F.col(month))).over(Window.partitionBy(customer))
    return (mrr.filter(F.col(customer).isNotNull()).withColumn("last_new_month", last_new)
            .filter(F.col(month) >= F.col("last_new_month"))
            .select(customer, month, "total_mrr", "is_lost", "last_new_month"))


def lifetime_stats(m: DataFrame, customer: str = "customer_id", month: str = "month_ending") -> DataFrame:
    """Lifetime value, month rows (COUNT(*) counts rows) and first month per customer."""
    return m.groupBy(customer).agg(
        F.sum("total_mrr").cast("decimal(38,2)").alias("lifetime_value"),
        F.count(F.lit(1)).alias("lifetime_months"),
        F.min(month).alias("first_month"))


def starting_mrr(mrr: DataFrame, life: DataFrame) -> DataFrame:
    """Revenue row(s) of the customer's first active month."""
    firsts = life.select("customer_id", F.col("first_month").alias("month_ending"))
    return mrr.join(firsts, ["customer_id", "month_ending"]).select(
        "month_ending", "customer_id", "total_mrr")


def first_month_bundles(products: DataFrame, life: DataFrame, family: str = CORE_FAMILY,
                        restrict_first_month: bool = True) -> DataFrame:
    """Core products held in the first active month (the original 'deduped' set, not deduped)."""
    cp = products.filter(F.col("product_family") == family)
    keys = life.select(F.col("customer_id").alias("finance_id"),
                       F.col("first_month").alias("month_ending"))
    on = ["finance_id", "month_ending"] if restrict_first_month else ["finance_id"]
    if not restrict_first_month:
        keys = keys.select("finance_id")
    return cp.join(keys, on, "left_semi").select("month_ending", "finance_id", "product_name")


def bundle_month_bounds(bundles: DataFrame) -> DataFrame:
    """First and last bundle month per customer, from one aggregate."""
    return bundles.groupBy("finance_id").agg(F.min("month_ending").alias("first_m"),
                                             F.max("month_ending").alias("last_m"))


def starting_bundle(bundles: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Bundle rows of the customer's first bundle month (ties kept)."""
    if bounds is None:
        return keep_extreme(bundles, ["finance_id"], "month_ending", "min")
    return bundles.join(bounds.select("finance_id", F.col("first_m").alias("month_ending")),
                        ["finance_id", "month_ending"], "left_semi")


def current_bundle(bundles: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Bundle rows of the customer's last bundle month (ties kept)."""
    if bounds is None:
        return keep_extreme(bundles, ["finance_id"], "month_ending", "max")
    return bundles.join(bounds.select("finance_id", F.col("last_m").alias("month_ending")),
                        ["finance_id", "month_ending"], "left_semi")


def churn_list(m: DataFrame) -> DataFrame:
    return m.filter(F.col("is_lost") == F.lit(True)).select("customer_id", "month_ending", "is_lost")


# --------------------------------------------------------------------------- support
def support_case_weeks(support: DataFrame, account: DataFrame | None = None) -> DataFrame:
    """Support cases with reason and week number since billing start.

    ``account`` reproduces the original left join to accounts, whose only
    effect is to repeat a case once per duplicate account row.
    """
    sup = support.filter(F.col("location_id").isNotNull())
    if account is not None:
        sup = sup.join(account.select("location_id"), "location_id", "left")
    return sup.select(
        "created_at", "interaction_number", "location_id", "billing_start_date",
        F.coalesce("primary", "reason_topic").alias("support_reason"), "subject",
        X.week_number("billing_start_date", "created_at").alias("week"))


def support_case_counts(weeks: DataFrame) -> DataFrame:
    """Weekly case counts (weeks 1-12) and week 1-4 reason counts in ONE aggregate.

    A location with cases but none in weeks 1-4 keeps null reason counts, the
    same as a left join to a separately grouped reason table.
    """
    in_first = F.col("week").isin(*REASON_WEEKS)
    has_first = F.count_if(in_first) > 0
    aggs = [F.count_if(F.col("week") == k).alias(f"week_{k}_cases") for k in CASE_WEEKS]
    for name, pattern in X.REASON_PATTERNS.items():
        hits = F.sum(F.when(in_first, X.ilike_count("support_reason", pattern)).otherwise(0))
        aggs.append(F.when(has_first, hits).alias(name))
    return weeks.groupBy("location_id").agg(*aggs)


def weekly_case_counts(weeks: DataFrame) -> DataFrame:
    counts = support_case_counts(weeks)
    return counts.select("location_id", *[f"week_{k}_cases" for k in CASE_WEEKS])


def support_reasons_pivot(weeks: DataFrame) -> DataFrame:
    counts = support_case_counts(weeks)
    names = list(X.REASON_PATTERNS)
    return counts.filter(F.col(names[0]).isNotNull()).select("location_id", *names)


# --------------------------------------------------------------------------- usage
def first_month_usage(usage: DataFrame, account: DataFrame, m: DataFrame,
                      max_gap_months: int = 1) -> DataFrame:
    """Usage of each customer's first reported month, if it starts within the gap.

    The original joins usage to every history row and removes the fan-out
    with DISTINCT; ``last_new_month`` is constant per customer, so joining to
    the distinct (customer, last_new_month) pairs gives the same rows without
    the fan-out.  A kept row is in its customer's first month, so in its own
    location's first month too: all other months go before any join.
    """
    restart = m.select("customer_id", "last_new_month").distinct()
    acct = account.select("location_id", F.col("finance_number").alias("customer_id"))
    own_first = F.min("report_month").over(Window.partitionBy("location_id"))  # a row per location and month
    usage = (usage.filter(F.col("location_id").isNotNull()).withColumn("_own_first", own_first)
             .filter(F.col("report_month") == F.col("_own_first")).drop("_own_first"))
    stage = cut_lineage(usage.join(acct, "location_id").join(restart, "customer_id"))  # read twice below
    first = stage.groupBy("customer_id").agg(F.min("report_month").alias("first_usage_month"))
    return (
        stage.join(first, "customer_id")
        .filter((F.col("report_month") == F.col("first_usage_month"))
                & (X.month_gap("last_new_month", "first_usage_month") <= max_gap_months))
        .select("location_id", "customer_id", "report_month", "first_usage_month",
                "last_new_month", *USAGE_COLUMNS)
        .distinct()
    )


# --------------------------------------------------------------------------- accounts, cases
def business_segments(account: DataFrame) -> DataFrame:
    return account.filter(F.col("location_id").isNotNull()).select(
        "location_id",
        X.hierarchy_tier("number_of_locations_in_hierarchy_active").alias("business_segment_by_hierarchy_active"),
        X.hierarchy_tier("number_of_locations_in_hierarchy_total").alias("business_segment_by_hierarchy_total"))


def distinct_segments(opportunities: DataFrame) -> DataFrame:
    """(account, segment) pairs, de-duplicated (a GROUP BY used as DISTINCT)."""
    return opportunities.select("account_id", "business_segment_by_hierarchy").dropDuplicates()


def latest_case(cases: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Cancellation case(s) with the latest created date per location; ties kept.

    With ``locations`` (a ``location_id`` column) only their cases are kept.  The
    dates are settled on narrow rows first; texts take part in one semi-join.
    """
    cols = ["location_id", "case_id", "case_status", "created_date", "cancel_summary",
            "cancellation_reason", "cancellation_subreason"]
    latest = cases.groupBy("location_id").agg(F.max("created_date").alias("created_date"))
    if locations is not None:
        latest = latest.join(locations.select("location_id").distinct(), "location_id", "left_semi")
    return cases.select(*cols).join(cut_lineage(latest), ["location_id", "created_date"], "left_semi")


# --------------------------------------------------------------------------- wide row
WIDE_COLUMNS = [
    "SLUG", "FINANCE_ID", "LOCATION_ID", "LOCATION_NAME",
    "BUSINESS_SEGMENT_BY_HIERARCHY_ACTIVE", "BUSINESS_SEGMENT_BY_HIERARCHY_TOTAL",
    "CORE_INDUSTRY", "CORE_SUB_INDUSTRY", "SPECIALTY", "IS_PARENT_ACCOUNT", "IS_SATELLITE",
    "LOCATION_TYPE", "BILLING_START_DATE", "STARTING_MRR", "LIFETIME_VALUE", "FIRST_MRR_MONTH",
    "PRACTICE_MANAGEMENT_SOFTWARE", "INTEGRATIONS", "ONBOARDING_HANDOFF_DATE",
    "STARTING_BUNDLE", "END_BUNDLE", "CHURN_OR_RETAIN", "CHURN_MONTH", "LIFETIME_MONTHS",
    *[f"WEEK_{k}_CASES" for k in CASE_WEEKS],
    "REASON_BILLING", "REASON_PHONE_SYSTEM", "REASON_DATA_SYNC",
    "FIRST_USAGE_REPORT_MONTH", "FIRST_INBOUND_SMS_COUNT", "FIRST_OUTBOUND_SMS_COUNT",
    "FIRST_INBOUND_CALL_COUNT", "FIRST_OUTBOUND_CALL_COUNT", "FIRST_MISSED_CALL_SMS_COUNT",
    "FIRST_MISSED_TEXT_SMS_COUNT", "FIRST_AUTOMATED_SMS_COUNT",
    "FIRST_APPOINTMENT_REMINDERS_ACCESS", "FIRST_MISSED_CALL_TEXT", "FIRST_MISSED_TEXT_TEXT",
    "SWAT_CASE_ID", "SWAT_CASE_STATUS", "SWAT_CASE_CREATED_DATE", "SWAT_CANCEL_SUMMARY",
    "SWAT_CANCELLATION_REASON", "SWAT_CANCELLATION_SUBREASON",
]


def _prefixed(df: DataFrame, key_map: Mapping[str, str], prefix: str) -> DataFrame:
    """Rename join keys to the spine's names and prefix every other column."""
    return df.select(*[F.col(c).alias(key_map.get(c, prefix + c)) for c in df.columns])


def _customer_side(spine: DataFrame, m: DataFrame, products: DataFrame, dedupe_bundles: bool) -> DataFrame:
    """Per finance id of the spine: lifetime, first-month revenue, bundles and loss (several rows where a part has)."""
    fin = {"customer_id": "finance_id", "finance_id": "finance_id"}
    life = lifetime_stats(m)
    bundles = first_month_bundles(products, life)
    if dedupe_bundles:
        bundles = bundles.groupBy("finance_id", "month_ending").agg(F.min("product_name").alias("product_name"))
    bundles = cut_lineage(bundles)
    bounds = bundle_month_bounds(bundles)  # one aggregate serves both bundle ends
    # the first month's revenue rows are in the history, which begins with that month
    parts = [_prefixed(starting_mrr(m, life).select("customer_id", "total_mrr"), fin, "smrr_"), _prefixed(life, fin, "life_"),
             _prefixed(starting_bundle(bundles, bounds).select("finance_id", "product_name"), fin, "sbun_"),
             _prefixed(current_bundle(bundles, bounds).select("finance_id", "product_name"), fin, "cbun_"),
             _prefixed(churn_list(m), fin, "churn_")]
    side = spine.select("finance_id").distinct()
    for part in parts:
        side = side.join(part, "finance_id", "left")
    return side


def _location_side(spine: DataFrame, weeks: DataFrame, integrations: DataFrame, usage: DataFrame, account: DataFrame) -> DataFrame:
    """Per location id of the spine: case counts, integration, first usage and size tiers."""
    key = {"location_id": "location_id"}
    parts = [_prefixed(support_case_counts(weeks), key, "wk_"),
             _prefixed(integrations.select("location_id", "integrations"), key, "int_"),
             _prefixed(usage.drop("customer_id"), key, "use_"), _prefixed(business_segments(account), key, "bs_")]
    side = spine.select("location_id").distinct()
    for part in parts:
        side = side.join(part, "location_id", "left")
    return side


def _most_rows(*parts: tuple[DataFrame, str]) -> int:
    """A bound on the rows of one location: the product of the most rows that each part has for a value of its key."""
    counts = at_once(*[(lambda p=part, k=key: p.groupBy(k).count().agg(F.max("count")).first()[0]) for part, key in parts])
    return math.prod(max(n or 1, 1) for n in counts)


def wide_parts(sources: Mapping[str, DataFrame], account_join_for_cases: bool = False,
               dedupe_bundles: bool = False, write_cases: bool = False) -> dict[str, DataFrame]:
    """What the wide row joins: the location spine, accounts by slug, and written tables by customer, location and case.

    The revenue history is written once and serves every per-customer part.  The
    parts of a key are first brought together per customer and per location
    (those joins share one partitioning) and written narrow, so the location
    spine is joined once per key, with a shuffle stage on both sides.
    """
    account = sources["account_v2"]
    spine = sources["location"]
    m = cut_lineage(active_history(sources["mrr_by_location"]))

    def customers() -> DataFrame:
        return cut_lineage(_customer_side(spine, m, sources["churn_by_product"], dedupe_bundles))

    def locations() -> DataFrame:
        weeks = support_case_weeks(sources["support_interaction_v3"], account if account_join_for_cases else None)
        usage = first_month_usage(sources["location_feature_access_and_usage_by_month"], account, m)
        return cut_lineage(_location_side(spine, weeks, sources["stg_location_integrations"], usage, account))

    by_customer, by_location = at_once(customers, locations)  # neither needs the other
    lost_locations = spine.join(by_customer.filter("churn_is_lost").select("finance_id").distinct(), "finance_id", "left_semi")
    sw = _prefixed(latest_case(sources["swat_case"], lost_locations), {}, "sw_")
    sw = cut_lineage(sw) if write_cases else sw
    acc = _prefixed(account.drop("location_id", "finance_number"), {"slug": "slug"}, "acc_")
    return {"spine": spine, "acc": acc, "by_customer": by_customer, "by_location": by_location, "sw": sw}


def wide_customer_row(sources: Mapping[str, DataFrame], account_join_for_cases: bool = False,
                      dedupe_bundles: bool = False, zero_fill_cases: bool = False,
                      row_key: Sequence[str] | None = None, parts: Mapping[str, DataFrame] | None = None,
                      chosen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The 56-column per-location row (left joins onto the location spine).

    With ``row_key``, which begins with LOCATION_ID, the rows get their id
    (``add_row_id``): where the join on the location left them, unless the parts
    allow a location more than ``ROWS_IN_PLACE`` rows.

    ``zero_fill_cases=True`` gives locations without any support case weekly
    counts of 0 instead of null (the original leaves null, so such locations
    later fail the complete-weeks filter).

    ``parts`` are those of ``wide_parts``, if they are there already.

    ``chosen`` names the locations that a reader needs.  It gets the wide rows
    before a slug's accounts multiply them (one row stands for all accounts, with a
    value in an account column if any has one; a case text is empty, not its own)
    and returns their LOCATION_ID column, distinct.  The rows of these locations are
    then built, all of them, so that the ids are those of the whole wide row.  Only
    a whole-number location is restricted: others may share a business key.
    """
    if parts is None:
        parts = wide_parts(sources, account_join_for_cases, dedupe_bundles, write_cases=bool(row_key))  # cases: counted and joined
    if chosen is not None:
        one = parts["acc"].groupBy("slug").agg(*[F.max(c).alias(c) for c in parts["acc"].columns if c != "slug"])
        brief = parts["sw"].withColumn("sw_cancel_summary", F.substring("sw_cancel_summary", 1, 0))
        locations = chosen(_wide_rows({**parts, "acc": one, "sw": brief}, zero_fill_cases)).select(F.col("LOCATION_ID").alias("location_id"))
        if isinstance(parts["spine"].schema["location_id"].dataType, IntegralType):
            parts = {**parts, "spine": cut_lineage(parts["spine"].join(locations, "location_id", "left_semi"))}
    wide = _wide_rows(parts, zero_fill_cases, numbered=bool(row_key))
    if not row_key:
        return wide
    most = _most_rows((parts["spine"], "location_id"), (parts["acc"], "slug"), (parts["by_customer"], "finance_id"),
                      (parts["by_location"], "location_id"), (parts["sw"], "sw_location_id"))
    return add_row_id(wide, row_key, placed_by="LOCATION_ID" if most <= ROWS_IN_PLACE else None)


def _wide_rows(parts: Mapping[str, DataFrame], zero_fill_cases: bool, numbered: bool = False) -> DataFrame:
    spine, acc, by_customer, by_location, sw = (parts[k] for k in ("spine", "acc", "by_customer", "by_location", "sw"))
    row = spine.join(acc, "slug", "left").join(by_customer, "finance_id", "left")
    row = row.join(by_location.hint("merge") if numbered else by_location, "location_id", "left")
    lost = F.coalesce(F.col("churn_is_lost"), F.lit(False))
    row = row.join(sw, (row.location_id == sw.sw_location_id) & lost, "left")

    c = F.col
    cols: list[Column] = [
        c("slug"), c("finance_id"), c("location_id"), c("location_name"),
        c("bs_business_segment_by_hierarchy_active"), c("bs_business_segment_by_hierarchy_total"),
        c("core_industry"), c("core_sub_industry"), c("specialty"), c("acc_is_parent_account"),
        c("is_satellite"), c("location_type"), c("acc_billing_start_date"),
        c("smrr_total_mrr").cast("decimal(38,2)"), c("life_lifetime_value"), c("life_first_month"),
        F.coalesce(c("int_integrations"), c("practice_management_software")), c("int_integrations"),
        c("acc_onboarding_handoff"), c("sbun_product_name"), c("cbun_product_name"),
        X.churn_status("churn_is_lost"), c("churn_month_ending"),
        X.tenure_months("churn_is_lost", "life_lifetime_months"),
        *[(F.coalesce(c(f"wk_week_{k}_cases"), F.lit(0).cast("long")) if zero_fill_cases
           else c(f"wk_week_{k}_cases")) for k in CASE_WEEKS],
        *[c(f"wk_{n}") for n in X.REASON_PATTERNS],
        c("use_report_month"),
        *[c("use_" + u) for u in ("inbound_sms_count", "outbound_sms_count", "inbound_call_count",
                                  "outbound_call_count", "missed_call_sms_count",
                                  "missed_text_sms_count", "automated_sms_sent_count",
                                  "has_appointment_reminders", "has_missed_call_text",
                                  "has_missed_text_text")],
        c("sw_case_id"), c("sw_case_status"), c("sw_created_date"), c("sw_cancel_summary"),
        c("sw_cancellation_reason"), c("sw_cancellation_subreason"),
    ]
    return row.select(*[col.alias(name) for col, name in zip(cols, WIDE_COLUMNS)])


# --------------------------------------------------------------------------- cohort (stage-1 cleaning)
def cohort_filter(wide: DataFrame, retain_min: int = 12, churn_range: tuple[int, int] = (1, 6),
                  since: str | None = "2024-01-01") -> DataFrame:
    """Retain rows with tenure > retain_min plus Churn rows with tenure in churn_range,
    started on/after ``since`` (unparseable dates drop out)."""
    from ..functions.columns import ColumnPlan
    names = ColumnPlan(wide).any_case(["CHURN_OR_RETAIN", "LIFETIME_MONTHS", "FIRST_MRR_MONTH"])
    status, months = F.col(names["CHURN_OR_RETAIN"]), F.col(names["LIFETIME_MONTHS"])
    keep = (((status == X.RETAIN) & (months > retain_min))
            | ((status == X.CHURN) & months.between(*churn_range)))
    out = wide.filter(keep)
    if since is not None and "FIRST_MRR_MONTH" in names:
        first = F.try_to_timestamp(F.col(names["FIRST_MRR_MONTH"]).cast("string"))
        out = out.filter(first >= F.lit(since).cast("timestamp"))
    return out
