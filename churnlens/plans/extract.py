"""Stage 1 plan: sources -> wide row -> cohort (combined and churn-only outputs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import cleaning, cohort
from ..session import cut_lineage

ID_COLUMNS = ["SLUG", "FINANCE_ID", "LOCATION_ID", "LOCATION_NAME"]
WEEK_COLUMNS = [f"WEEK_{k}_CASES" for k in range(1, 13)]
STAGE1_USAGE = ["FIRST_INBOUND_SMS_COUNT", "FIRST_OUTBOUND_SMS_COUNT",
                "FIRST_INBOUND_CALL_COUNT", "FIRST_OUTBOUND_CALL_COUNT"]


def clean_cohort(wide: DataFrame, retain_min: int = 12, churn_range: tuple[int, int] = (1, 6),
                 since: str | None = "2024-01-01", drop_empty_columns: bool = True,
                 empty_columns: Sequence[str] | None = None) -> DataFrame:
    """Cohort filter, required ids, all-null column drop, then week and usage completeness.

    The all-null column drop runs before the week/usage row filters: an
    all-null week column is removed instead of emptying the table.
    ``empty_columns`` names these columns where they are known (``cohort_locations``).
    """
    out = cohort.cohort_filter(wide, retain_min, churn_range, since)
    out = cleaning.complete_rows_ci(out, ID_COLUMNS)
    if drop_empty_columns and empty_columns is not None:
        out = out.drop(*empty_columns)
    elif drop_empty_columns:
        # written once, so the column scan and the consumers read the same rows
        out = cleaning.drop_all_null_columns(cut_lineage(out))
    out = cleaning.complete_rows_ci(out, WEEK_COLUMNS)
    return cleaning.complete_rows_ci(out, STAGE1_USAGE)


def cohort_locations(wide: DataFrame, retain_min: int = 12, churn_range: tuple[int, int] = (1, 6),
                     since: str | None = "2024-01-01") -> tuple[DataFrame, list[str]]:
    """The locations that keep a row in ``clean_cohort``, and the columns it drops as all-null (all of them without rows).

    The filters ask which values are there, not what they are: one flag a value is written.
    """
    rows = cleaning.complete_rows_ci(cohort.cohort_filter(wide, retain_min, churn_range, since), ID_COLUMNS)
    there = cut_lineage(cleaning.present_or_null(rows, beside={"_location": "LOCATION_ID"}))
    kept = cleaning.drop_all_null_columns(there)
    empty = [c for c in wide.columns if c not in kept.columns]
    kept = cleaning.complete_rows_ci(cleaning.complete_rows_ci(kept, WEEK_COLUMNS), STAGE1_USAGE)
    if "_location" not in kept.columns:  # no row at all
        kept = there
    return kept.select(F.col("_location").alias("LOCATION_ID")).distinct(), empty


def churn_cohort(cohort_df: DataFrame) -> DataFrame:
    """Churn-only subset of the cleaned cohort."""
    return cohort_df.filter(F.col("CHURN_OR_RETAIN") == X.CHURN)
