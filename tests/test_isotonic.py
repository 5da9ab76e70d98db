"""Isotonic regression by hulls against plain pooling, MLlib, and its own parts."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators.isotonic import IsotonicFit, fit_isotonic, pool
from churnlens.operators.ranking import latest_mark


def pooled(points):
    """Adjacent violators pooled one by one: [lo, hi, weight, label sum]."""
    out = []
    for x, w, s in sorted(points):
        out.append([x, x, w, s])
        while len(out) > 1 and Fraction(out[-2][3], out[-2][2]) >= Fraction(out[-1][3], out[-1][2]):
            _, hi, w2, s2 = out.pop()
            out[-1][1:] = [hi, out[-1][2] + w2, out[-1][3] + s2]
    return out


def sums(rows):
    by = {}
    for x, y in rows:
        if x is not None and y is not None:
            w, s = by.get(x, (0, 0))
            by[x] = (w + 1, s + y)
    return [(x, w, s) for x, (w, s) in by.items()]


def blocks(fit):
    return sorted([r["lo"], r["hi"], r["w"], r["wy"]] for r in fit.knots.collect())


@pytest.mark.parametrize("parts", [1, 7, 100])
def test_blocks_are_those_of_plain_pooling(spark, parts):
    rng = random.Random(parts)
    rows = [(float(rng.randrange(400)), int(rng.random() < 0.2 + 0.001 * i % 0.6)) for i in range(3000)] + [(None, 1), (3.0, None)]
    df = spark.createDataFrame(rows, "x double, y int")
    assert blocks(fit_isotonic(df, "x", "y", parts)) == pooled(sums(rows))


def test_a_hundred_thousand_scores(spark):
    """Every score distinct: exact against plain pooling, and far fewer blocks than scores."""
    df = spark.range(100_000).select((F.col("id") / 7.0).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) < F.col("id")).cast("int").alias("y"))
    fit = fit_isotonic(df, "x", "y", 16)
    want = pooled([(r["x"], 1, r["y"]) for r in df.collect()])
    assert blocks(fit) == want and len(want) < 2 * 100_000 ** (2 / 3)
    out = fit.transform(df, "x", "p").agg(F.count(F.lit(1)), F.round(F.sum("p"), 4), F.sum("y")).first()
    assert out[0] == 100_000 and abs(out[1] - out[2]) < 1e-3  # a fit keeps the total


def test_values_between_and_beyond_blocks(spark):
    rows = [(1.0, 0), (2.0, 0), (4.0, 1), (4.0, 0), (8.0, 1)]
    fit = fit_isotonic(spark.createDataFrame(rows, "x double, y int"), "x", "y", 3)
    asked = [None, float("nan"), -5.0, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 99.0, 99.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "hi int, x double")
    got = {r["hi"]: r["p"] for r in fit.transform(df, "x", "p").collect()}
    assert [got[i] for i in range(len(asked))] == [None, None, 0.0, 0.0, 0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 1.0, 1.0]


def test_same_as_mllib(spark):
    from pyspark.ml.regression import IsotonicRegression
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.gauss(0, 1), float(rng.random() < 0.4)) for _ in range(2000)], "x double, y double").cache()
    ours = fit_isotonic(df, "x", "y").transform(df, "x", "p")
    both = IsotonicRegression(featuresCol="x", labelCol="y", predictionCol="m").fit(df).transform(ours)
    assert both.agg(F.max(F.abs(F.col("p") - F.col("m")))).first()[0] < 1e-12


def test_one_class_one_score_and_no_rows(spark):
    one = fit_isotonic(spark.createDataFrame([(2.0, 1)] * 5, "x double, y int"), "x", "y")
    assert blocks(one) == [[2.0, 2.0, 5, 5]]
    none = fit_isotonic(spark.createDataFrame([], "x double, y int"), "x", "y")
    df = spark.createDataFrame([(1.0,)], "x double")
    assert none.transform(df, "x", "p").first()["p"] is None


def test_save_and_load(spark, tmp_path):
    df = spark.createDataFrame([(float(i), i % 3 // 2) for i in range(50)], "x double, y int")
    fit = fit_isotonic(df, "x", "y")
    fit.save(str(tmp_path / "iso"))
    assert blocks(IsotonicFit.load(str(tmp_path / "iso"))) == blocks(fit)


def test_pool_beyond_64_bits():
    big = 2 ** 40
    lo = np.arange(4.0)
    got = pool(lo, lo, np.array([big, big, big, big]), np.array([0, big, big - 1, big]))
    assert got[3].tolist() == [0, 2 * big - 1, big] and got[2].tolist() == [big, 2 * big, big]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_latest_mark(spark, parts):
    rng = random.Random(1)
    marks = sorted(rng.sample(range(1000), 30))
    keys = [rng.randrange(-50, 1050) for _ in range(500)] + [marks[3]] * 300 + [None] * 3
    m = spark.createDataFrame([(float(x), f"m{x}", None) for x in marks], "at double, name string, void string")
    rows = spark.createDataFrame([(i, k, "n") for i, k in enumerate(keys)], "id int, key int, name string")
    got = latest_mark(rows, F.col("key").cast("double"), m, "at", ["name", "void"], "found", parts).collect()
    assert len(got) == len(keys)
    for r in got:
        below = [x for x in marks if r["key"] is not None and x <= r["key"]]
        assert (r["found"]["name"] if r["found"] else None) == (f"m{below[-1]}" if below else None) and r["name"] == "n"
