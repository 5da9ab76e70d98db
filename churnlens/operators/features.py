"""Stage 2 feature engineering: cohort row -> enriched row and model row.

Schema-dependent steps (all-null column drop, one-hot levels) each run one
small aggregate job whose result is bounded by the number of columns or
levels; everything else is a lazy column expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import expressions as X
from ..functions.columns import DROP_COLUMNS, ColumnPlan
from . import cleaning
from .cleaning import q

# Column names and feature lists of the original model stage.
STATUS, TENURE = "Churn or Retain", "lifetime in Month"
SEGMENT_COLUMN = "BUSINESS_SEGMENT_BY_HIERARCHY_ACTIVE"
ID_COLUMNS = ["Slug", "Finance Id", "Location Id", "Location Name"]
WEEK_COLUMNS = [f"Week {k} Cases" for k in range(1, 13)]
FIRST_WEEKS = [f"Week {k} Cases" for k in range(1, 5)]
USAGE_COLUMNS = ["Inbound Sms Count", "Outbound Sms Count", "Automated Sms Sent Count",
                 "Manual Messages Sms Count", "Inbound Call Count", "Outbound Call Count"]
REASON_COLUMNS = ["Reason Billing", "Reason Phone System", "Reason Data Sync"]
PMS_COLUMN, INTEGRATION_COLUMN = "Practice Management Software", "Integrations"
DUMMY_COLUMNS = ["Core Industry", "PMS_Group", "BundleType"]
LABEL = "churn_flag"
MODEL_FEATURES = [
    "Core Industry_Medical",
    "BundleType_core bundle",
    "Week 1 Cases",
    "Week 2 Cases",
    "Week 3 Cases",
    "Week 4 Cases",
    "Inbound Sms Count Activated",
    "Outbound Sms Count Activated",
    "Inbound Call Count Activated",
    "Outbound Call Count Activated",
    "Reason Billing Flag",
    "Reason Data Sync Flag",
    "PMS_Group_EOD pms",
]
NOTEBOOK_FEATURES = [f for f in MODEL_FEATURES if f != "Reason Billing Flag"]
ROW_KEY = ["Location Id", "Churn Month", "Starting Bundle", "End Bundle", "SWAT_CASE_ID",
           "First Usage Report Month"]
ROW_ID = "row_id"
# Id columns looked up, first present wins.
ID_CANDIDATES = ["account_id", "customer_id", "location_id", "id", "AccountId", "CustomerId", "Location Id"]


def add_row_id(df: DataFrame, keys: Sequence[str] = ROW_KEY, name: str = ROW_ID, placed_by: str | None = None) -> DataFrame:
    """Unique row identity, carried end to end in place of the original's positional index.

    md5 of the business key, an absent or null part counting as empty; the
    second and later rows of one key get ``-2``, ``-3`` ... after it, in the
    order of a hash of the whole row, so equal keys never share an id.  It is
    assigned once, before the cohort is written, and never recomputed.

    ``placed_by`` names the first key if a join on it has just placed the rows:
    where it is a whole number, equal business keys have it in common, so the
    rows are numbered where they are instead of being shuffled once more.  All
    rows of one value are then one task's work.
    """
    if placed_by is not None and placed_by != keys[0]:
        raise ValueError("rows can only be numbered in place by the first key")
    in_place = placed_by is not None and isinstance(df.schema[placed_by].dataType, IntegralType)
    present = set(df.columns)
    parts = [F.coalesce(q(k).cast("string"), F.lit("")) if k in present else F.lit("") for k in keys]
    tagged = df.withColumn("_key", F.md5(F.concat_ws("|", *parts))).withColumn(
        "_order", F.xxhash64(*[q(c) for c in df.columns]))
    alike = [q(placed_by), F.col("_key")] if in_place else [F.col("_key")]  # the same groups either way
    number = F.row_number().over(Window.partitionBy(*alike).orderBy("_order"))  # rows of one business key
    return (tagged.withColumn("_n", number)
            .withColumn(name, F.when(F.col("_n") == 1, F.col("_key")).otherwise(F.concat_ws("-", "_key", "_n")))
            .drop("_key", "_order", "_n"))


def single_location_filter(df: DataFrame, col: str = SEGMENT_COLUMN) -> DataFrame:
    if col not in df.columns:
        return df
    return df.filter(F.lower(X.strip_ws(q(col).cast("string"))) == "single")


def label_filter(df: DataFrame, churn_range: tuple[int, int] = (1, 6)) -> DataFrame:
    """All Retain rows plus Churn rows with tenure inside ``churn_range``."""
    s = q(STATUS)
    return df.filter((s == X.RETAIN) | ((s == X.CHURN) & q(TENURE).between(*churn_range)))


def first_month_cases(df: DataFrame, skip_null: bool = True):
    weeks = ColumnPlan(df).present(FIRST_WEEKS)
    if not weeks:
        return F.lit(None).cast("bigint")
    terms = [F.coalesce(q(w), F.lit(0)) if skip_null else q(w) for w in weeks]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def one_hot_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null levels per column, from one distributed distinct.

    Every level becomes a column of the result, so its names reach the driver;
    there is no bound on their number besides what a schema can hold.
    """
    if not cols:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), q(c).cast("string").alias("v"))
                                for i, c in enumerate(cols)]))
    rows = (df.select(pairs.alias("p")).select("p.k", "p.v").where(F.col("v").isNotNull())
            .distinct().collect())
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[cols[r["k"]]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, cols: Sequence[str], levels: dict[str, list[str]] | None = None,
            keep_source: bool = False) -> DataFrame:
    """Replace each column by ``<col>_<level>`` 0/1 columns (null -> all zeros), appended
    after the remaining columns; pass ``levels`` to reuse a fitted encoding."""
    cols = ColumnPlan(df).present(cols)
    levels = levels if levels is not None else one_hot_levels(df, cols)
    keep = [q(c) for c in df.columns if keep_source or c not in cols]
    dummies = [F.coalesce((q(c).cast("string") == v).cast("tinyint"), F.lit(0).cast("tinyint"))
               .alias(f"{c}_{v}") for c in cols for v in levels.get(c, [])]
    return df.select(*keep, *dummies)


def engineer_features(df: DataFrame, churn_range: tuple[int, int] = (1, 6),
                      core_token: str = X.DEFAULT_CORE_TOKEN, plus_token: str = X.DEFAULT_PLUS_TOKEN,
                      null_as_text: bool = False, require_pms: bool = False,
                      pms_source: str = "lookup", skip_null_weeks: bool = True,
                      levels: dict[str, list[str]] | None = None,
                      drop_empty_columns: bool = True,
                      keep_source: bool = False, with_model: bool = True) -> tuple[DataFrame, DataFrame]:
    """Return (enriched rows, model rows) from a standardised cohort frame.

    ``pms_source='pms'`` and ``require_pms=True`` and ``skip_null_weeks=False``
    give the notebook variant.
    """
    if ROW_ID not in df.columns:
        df = add_row_id(df)
    df = single_location_filter(df)
    df = df.filter(q(STATUS).isin(X.RETAIN, X.CHURN))
    df = label_filter(df, churn_range)
    drop = ColumnPlan(df).present(DROP_COLUMNS)
    if drop:
        df = df.drop(*drop)
    df = cleaning.complete_rows(df, ID_COLUMNS)
    if drop_empty_columns:
        df = cleaning.drop_all_null_columns(df)
    df = cleaning.complete_rows(df, WEEK_COLUMNS)
    usage = ColumnPlan(df).present(USAGE_COLUMNS)
    df = cleaning.complete_rows(df, usage)
    df = df.withColumns({f"{c} Activated": X.activation_flag(q(c)) for c in usage})
    df = cleaning.complete_rows(df, ["Core Industry", "Starting Bundle"]
                                + ([PMS_COLUMN] if require_pms else []))
    df = cleaning.drop_missing_both(df, PMS_COLUMN, INTEGRATION_COLUMN, null_as_text)

    has_pms, has_int = PMS_COLUMN in df.columns, INTEGRATION_COLUMN in df.columns
    if pms_source == "pms":
        lookup = F.coalesce(q(PMS_COLUMN).cast("string"), F.lit("nan")) if has_pms else F.lit("")
    else:
        lookup = X.pms_lookup(q(INTEGRATION_COLUMN) if has_int else None,
                              q(PMS_COLUMN) if has_pms else None, null_as_text)
    derived = {
        "BundleType": X.bundle_type(q("Starting Bundle"), core_token, plus_token),
        "First Month SWAT Cases": first_month_cases(df, skip_null_weeks),
        "PMS_Group": X.pms_group(lookup),
    }
    derived.update({f"{c} Flag": X.positive_flag(q(c)) for c in ColumnPlan(df).present(REASON_COLUMNS)})
    enriched = df.withColumns(derived)
    # with_model=False: the caller writes the enriched rows first and derives the model rows from them
    return enriched, (model_frame(enriched, levels, keep_source) if with_model else None)


def model_frame(enriched: DataFrame, levels: dict[str, list[str]] | None = None,
                keep_source: bool = False) -> DataFrame:
    """One-hot columns and the 0/1 label over enriched rows (rows without a label dropped)."""
    model = one_hot(enriched, DUMMY_COLUMNS, levels, keep_source)
    return model.withColumn(LABEL, X.churn_label(q(STATUS))).filter(q(LABEL).isNotNull())


def available_features(df: DataFrame, wanted: Sequence[str] = MODEL_FEATURES) -> list[str]:
    feats = ColumnPlan(df).present(wanted)
    if not feats:
        raise ValueError("No model features found in the dataset after preprocessing.")
    return feats
