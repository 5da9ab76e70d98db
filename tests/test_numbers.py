"""Order statistics by refinement and sums in any order, against exact arithmetic."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from churnlens.operators import modeling as MO
from churnlens.operators import reports as RP
from churnlens.operators.exact_sums import exact_moments, exact_sums
from churnlens.operators.selection import exact_quantiles, select_ranks


def values(kind, n=2000):
    r = random.Random(kind)
    draw = {"flags": lambda: float(r.random() < 0.3), "normal": lambda: r.gauss(0, 1), "near": lambda: 1.0 + r.randrange(40) * 2.0 ** -52,
            "wide": lambda: r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300), "ends": lambda: r.choice([-1.7e308, 1.7e308, 0.0, 5e-324, -0.0]),
            "one": lambda: 7.25}[kind]
    return [draw() for _ in range(n)]


@pytest.mark.parametrize("kind", ["flags", "normal", "near", "wide", "ends", "one"])
def test_ranks_are_those_of_the_sorted_values(spark, kind):
    vals = values(kind)
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    asked, ordered = [0, 1, 999, 1000, 1998, 1999], sorted(vals)
    got = select_ranks(df, {"v": F.col("v")}, {"v": asked}, {"v": (ordered[0], ordered[-1])}, bins=64)
    assert [got["v", k] for k in asked] == [ordered[k] for k in asked]


def test_many_columns_together(spark):
    rows = [(i, values("normal", 101)[i], None if i % 2 else float(i), None, float("nan") if i == 5 else 1.0 / (i + 1), float("inf") if i < 60 else -1.0) for i in range(101)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, e double")
    got = exact_quantiles(df, {c: (F.col(c), [0.5, 0.25]) for c in "iabcde"}, bins=8)
    assert got["i"] == [50.0, 25.0] and got["b"] == [50.0, 25.0] and got["c"] == [None, None] and got["e"][0] > 1e308
    a = sorted(r[1] for r in rows)
    assert got["a"] == [a[50], a[25]]
    d = sorted(r[4] for r in rows if r[4] == r[4])
    assert got["d"] == [d[49] + 0.5 * (d[50] - d[49]), d[24] + 0.75 * (d[25] - d[24])]


@pytest.mark.parametrize("kind", ["flags", "normal", "near", "wide", "one"])
def test_sums_do_not_hang_on_the_partitions(spark, kind):
    vals = values(kind, 3000)
    if kind == "wide":
        vals = [v for v in vals if abs(v) < 1e200]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(vals)], "g int, v double")
    got = {tuple(sorted((r["g"], r["s"]) for r in exact_sums(df.repartition(n).sortWithinPartitions(F.rand(n)), {"s": F.col("v")}, [F.col("g")]).collect()))
           for n in (1, 7, 64)}
    assert len(got) == 1
    peak = max(map(abs, vals))
    for g, s in got.pop():
        own = [Fraction(v) for i, v in enumerate(vals) if i % 3 == g]
        assert abs(Fraction(s) - sum(own)) <= Fraction(peak) * len(own) / 2 ** 64 + abs(Fraction(s)) / 2 ** 52


def test_odd_sums(spark):
    df = spark.createDataFrame([(None, 1.0, 5e-324, 1e308), (None, float("inf"), -5e-324, 1e308)], "a double, b double, c double, d double")
    r = exact_sums(df, {c: F.col(c) for c in "abcd"}).first()
    assert r["a"] is None and r["b"] == math.inf and r["c"] == 0.0
    assert exact_sums(df.where("false"), {"a": F.col("b")}).first()["a"] is None
    assert exact_moments(df.where("false"), {"a": F.col("b")}) == {"a": (0, None, None)}


def test_statistics_are_bit_equal_over_any_partitions(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(r.randrange(40), r.gauss(50, 20), r.gauss(0, 1e-3)) for _ in range(4000)], "t int, m double, x double")
    seen = set()
    for n in (1, 7, 64):
        rows = df.repartition(n)
        seen.add((tuple(RP.tenure_revenue_summary(rows, "t", "m").first()), tuple(sorted(MO.fit_scaler(rows, ["m", "x"]).items()))))
        scaled = MO.standardise(rows, MO.fit_scaler(rows, ["m", "x"]))
        seen.add(tuple(sorted(v["x"] for v in scaled.collect()))[:5])
    assert len(seen) == 2
    (_, mean, std) = exact_moments(df, {"m": F.col("m")})["m"]
    vals = [Fraction(v["m"]) for v in df.collect()]
    assert math.isclose(mean, float(sum(vals) / 4000), rel_tol=1e-15) and math.isclose(std, math.sqrt(sum((v - sum(vals) / 4000) ** 2 for v in vals) / 4000), rel_tol=1e-14)
