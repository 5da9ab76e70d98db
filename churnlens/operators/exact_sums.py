"""Sums of doubles that do not hang on the order of the rows.

Every value is cut into three limbs of 22 bits below the largest magnitude of the
column, a power of two that one aggregate finds.  Cutting is exact, limbs are added
as whole numbers, and the sum of the limbs is rounded to a double once.  What lies
66 bits below the largest magnitude is left out, from each value alike.  The result
is the same on one partition or a thousand, and up to 2^40 rows keep each limb's
sum within 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 22


def exponents(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, int | None]:
    """The power of two above all magnitudes of each column: one aggregate (None: not finite)."""
    row = df.agg(*[F.max(F.abs(c.cast("double"))).alias(f"m{i}") for i, c in enumerate(columns.values())]).first()
    out: dict[str, int | None] = {}
    for i, name in enumerate(columns):
        peak = row[f"m{i}"]
        out[name] = None if peak is not None and not math.isfinite(peak) else max(math.frexp(peak or 0.0)[1], -900)
    return out


def exact_sum(column: Column, exponent: int | None) -> Column:
    """Aggregate expression for the sum of a column whose magnitudes are below 2^``exponent``; null without values."""
    x = column.cast("double")
    if exponent is None:  # an infinity or NaN decides the sum in any order
        return F.sum(x)
    rest = x * F.lit(2.0 ** (LIMB - exponent) if exponent <= 900 else 2.0 ** -450) * F.lit(1.0 if exponent <= 900 else 2.0 ** (LIMB - exponent + 450))
    total = None
    for shift in (2 * LIMB, LIMB, 0):
        limb = rest.cast("long")  # towards zero, so the rest is exact
        rest = (rest - limb) * F.lit(2.0 ** LIMB)
        part = F.sum(limb).cast("decimal(19,0)") * F.lit(1 << shift).cast("decimal(14,0)")
        total = part if total is None else total + part
    low = exponent - 3 * LIMB
    return total.cast("double") * F.lit(2.0 ** (low // 2)) * F.lit(2.0 ** (low - low // 2))


def exact_sums(df: DataFrame, columns: Mapping[str, Column], by: Sequence[Column] = (), **more: Column) -> DataFrame:
    """One row (for each group of ``by``) with the sum of every column, and further aggregates."""
    above = exponents(df, columns)
    return df.groupBy(*by).agg(*[exact_sum(c, above[name]).alias(name) for name, c in columns.items()], *[c.alias(k) for k, c in more.items()])


def exact_moments(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, tuple[int, float | None, float | None]]:
    """(values, mean, population standard deviation) of each column."""
    n = {f"n_{i}": F.count(c) for i, c in enumerate(columns.values())}
    row = exact_sums(df, {f"s_{i}": c for i, c in enumerate(columns.values())}, **n).first()
    mean = [row[f"s_{i}"] / row[f"n_{i}"] if row[f"n_{i}"] else None for i in range(len(columns))]
    off = {f"d_{i}": (c.cast("double") - F.lit(m)) * (c.cast("double") - F.lit(m)) for i, (c, m) in enumerate(zip(columns.values(), mean)) if m is not None}
    spread = exact_sums(df, off).first() if off else {}
    return {name: (row[f"n_{i}"], m, None if m is None else math.sqrt(spread[f"d_{i}"] / row[f"n_{i}"]))
            for i, (name, m) in enumerate(zip(columns, mean))}
