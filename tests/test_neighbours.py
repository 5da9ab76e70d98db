"""Nearest neighbours by a metric partition against all pairs."""

import numpy as np
import pytest

from churnlens.operators.neighbours import _nearest, nearest_neighbours


def brute(x, mult, k):
    keys = [f"v{i:05d}" for i in range(len(x))]
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        rows = sorted((d[j], keys[j]) for j in range(len(x)) for _ in range(mult[j] - (i == j)))
        out += [(keys[i], r + 1, key) for r, (_, key) in enumerate(rows[:k])]
    return sorted(out)


def vectors(spark, x, mult):
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(f"v{i:05d}", int(m), *map(float, v)) for i, (v, m) in enumerate(zip(x, mult))]
    return spark.createDataFrame(rows, "_vk string, _mult int, " + ", ".join(f"{c} double" for c in cols)), cols


@pytest.mark.parametrize("case", ["scattered", "line", "grid", "one cell", "lonely"])
def test_same_as_all_pairs(spark, case):
    rng = np.random.default_rng(len(case))
    x = {"scattered": rng.normal(size=(300, 3)), "line": np.linspace(0, 1, 200)[:, None] * np.ones((1, 2)),
         "grid": np.array([[a, b] for a in range(16) for b in range(16)], dtype=float),  # every distance tied
         "one cell": np.vstack([rng.normal(size=(350, 4)) * 1e-3, [[9.0] * 4]]),
         "lonely": np.vstack([np.zeros((1, 2)), 1e6 * np.eye(2), rng.normal(size=(60, 2)) + 500])}[case]
    x = np.unique(x, axis=0)
    mult = rng.choice([1, 1, 1, 2, 9], size=len(x))
    df, cols = vectors(spark, x, mult)
    got = sorted(tuple(r) for r in nearest_neighbours(df, cols, 5, block=16).select("_vk", "_nr", "_nvk").collect())
    assert got == brute(x, mult, 5)


def test_thirteen_features_without_a_main_axis_compare_few_pairs(spark):
    """Sixty groups in 13 equally spread dimensions: the same neighbours from under a tenth of the pairs."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 13))[rng.integers(0, 60, 4000)] + 0.05 * rng.normal(size=(4000, 13))
    df, cols = vectors(spark, x, np.ones(4000, dtype=int))
    trace = {}
    got = sorted(tuple(r) for r in nearest_neighbours(df, cols, 5, block=64, most_pivots=256, trace=trace).select("_vk", "_nr", "_nvk").collect())
    assert got == brute(x, np.ones(4000, dtype=int), 5)
    assert trace["vectors"] == 4000 and trace["pairs"] < 0.1 * 4000 ** 2


def test_few_vectors(spark):
    df, cols = vectors(spark, np.array([[0.0], [1.0]]), np.array([4, 3]))
    got = sorted(tuple(r) for r in nearest_neighbours(df, cols, 5).select("_vk", "_nr", "_nvk").collect())
    assert got == brute(np.array([[0.0], [1.0]]), [4, 3], 5)


def test_nearest_breaks_ties_by_key():
    a = np.zeros((1, 1))
    b = np.ones((30, 1))
    got = _nearest(np.array(["x"]), a, np.array([np.inf]), np.array([f"k{i:02d}" for i in range(29, -1, -1)]), b, np.ones(30, dtype=int), 3)
    assert got["_nvk"].tolist() == ["k00", "k01", "k02"]
