"""Exact order statistics of many columns at once, without a sort and without a map of values.

The values of a column between two bounds are counted in ``BINS`` equal bins; the
bin that holds the wanted rank is known from the counts, and its least and
greatest value are the next bounds.  A rank is settled once they are equal.  Each
round is one narrow aggregate over up to ``SPANS`` pairs of bounds, of any columns,
and brings at most ``BINS`` rows for each to the driver.  Columns with fewer distinct values than bins
settle in the first round; others narrow by ``BINS`` each round.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, SPANS = 2048, 64
_MAX = 1.7976931348623157e308


def _number(c: Column) -> Column:
    """As double; NaN counts as null, infinities as the largest numbers."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(_MAX)), F.lit(-_MAX)))


def select_ranks(df: DataFrame, columns: Mapping[str, Column], ranks: Mapping[str, Sequence[int]],
                 ends: Mapping[str, tuple[float, float]], bins: int = BINS) -> dict[tuple[str, int], float]:
    """The value at each 0-based rank of the non-null values; ``ends`` are the columns' least and greatest values."""
    found: dict[tuple[str, int], float] = {}
    open_ranks = {(c, r): (*ends[c], r) for c, wanted in ranks.items() for r in wanted}  # bounds, rank within them
    while True:
        found |= {k: lo for k, (lo, hi, _) in open_ranks.items() if lo == hi}
        open_ranks = {k: v for k, v in open_ranks.items() if k not in found}
        if not open_ranks:
            return found
        spans = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_ranks.items()})[:SPANS]  # the others wait for a later round
        parts = []
        for i, (c, lo, hi) in enumerate(spans):
            x, half = columns[c], 0.5 if math.isinf(hi - lo) else 1.0  # the difference may pass the largest double
            bin_ = F.least(F.floor((x * half - F.lit(lo * half)) / F.lit(hi * half - lo * half) * bins), F.lit(bins - 1)).cast("int")
            parts.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("span"), bin_.alias("bin"), x.alias("x"))))
        rows = df.select(F.explode(F.array(*parts)).alias("p")).where("p IS NOT NULL").groupBy("p.span", "p.bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("p.x").alias("lo"), F.max("p.x").alias("hi"))
        histogram: dict[int, list] = {i: [] for i in range(len(spans))}
        for r in rows.collect():
            histogram[r["span"]].append((r["bin"], r["n"], r["lo"], r["hi"]))
        number = {span: i for i, span in enumerate(spans)}
        for key, (lo, hi, rank) in open_ranks.items():
            if (key[0], lo, hi) not in number:
                continue
            for _, n, least, greatest in sorted(histogram[number[key[0], lo, hi]]):
                if rank < n:
                    open_ranks[key] = (least, greatest, rank)
                    break
                rank -= n


def exact_quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]], bins: int = BINS) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation (like ``percentile``) of several columns: name -> (column, quantiles)."""
    columns = {name: _number(c) for name, (c, _) in wanted.items()}
    aggs = [f(x).alias(f"{what}{i}") for i, x in enumerate(columns.values()) for what, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    row = df.agg(*aggs).first()
    ranks, ends, places = {}, {}, {}
    for i, (name, (_, qs)) in enumerate(wanted.items()):
        if n := row[f"n{i}"]:
            places[name] = [p * (n - 1) for p in qs]
            ranks[name] = sorted({r for p in places[name] for r in (int(p // 1), int(-(-p // 1)))})
            ends[name] = (row[f"lo{i}"], row[f"hi{i}"])
    at = select_ranks(df, columns, ranks, ends, bins)
    out: dict[str, list[float | None]] = {}
    for name, (_, qs) in wanted.items():
        if name not in ranks:
            out[name] = [None for _ in qs]
            continue
        ends_of = [(at[name, int(p // 1)], at[name, int(-(-p // 1))], p - p // 1) for p in places[name]]
        out[name] = [lo + part * (hi - lo) for lo, hi, part in ends_of]
    return out
