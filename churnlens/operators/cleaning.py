"""Row and column cleaning steps shared by the extract and model stages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ColumnPlan


def q(name: str):
    """Column reference that tolerates spaces and dots in names."""
    return F.col(f"`{name}`")


def present_or_null(df: DataFrame, beside: Mapping[str, str] | None = None) -> DataFrame:
    """True for each value, null where it is missing (null or NaN): the same columns, next to nothing to write.

    ``beside`` names more columns and the columns whose values they have.
    """
    fractional = (T.DoubleType, T.FloatType)
    there = [q(f.name).isNotNull() & ~F.isnan(q(f.name)) if isinstance(f.dataType, fractional) else q(f.name).isNotNull() for f in df.schema.fields]
    return df.select(*[F.when(t, F.lit(True)).alias(f.name) for t, f in zip(there, df.schema.fields)],
                     *[q(c).alias(name) for name, c in (beside or {}).items()])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns with no non-null value (NaN counts as missing, like pandas).

    One aggregate job returning a single row of per-column counts.
    """
    row = present_or_null(df).agg(*[F.count(q(f.name)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)]).first()
    empty = [f.name for i, f in enumerate(df.schema.fields) if row[f"n{i}"] == 0]
    return df.drop(*empty) if empty else df


def complete_rows(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """Drop rows with a null in any of the present ``subset`` columns."""
    cols = ColumnPlan(df).present(subset)
    return df.na.drop(how="any", subset=cols) if cols else df


def complete_rows_ci(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """``complete_rows`` with case-insensitive column names."""
    return complete_rows(df, list(ColumnPlan(df).any_case(subset).values()))


def drop_missing_both(df: DataFrame, pms: str = "Practice Management Software",
                      integrations: str = "Integrations", null_as_text: bool = False) -> DataFrame:
    """Drop rows whose PMS and integration texts are both blank.

    ``null_as_text=True`` reproduces the original, where a null becomes the
    text 'nan' and therefore never counts as blank.
    """
    have = ColumnPlan(df).present([pms, integrations])
    if not have:
        return df

    def blank(name: str):
        if name not in have:
            return F.lit(True)
        is_blank = F.trim(q(name)) == ""
        # null: blank by intent, the text 'nan' (not blank) in parity mode
        return F.coalesce(is_blank, F.lit(not null_as_text))

    return df.filter(~(blank(pms) & blank(integrations)))
