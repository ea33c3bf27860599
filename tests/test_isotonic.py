"""Pooled curves equal the minimax formula, and held-out strengths a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronowarn.operators import isotonic


def minimax(x, y, w):
    """Increasing fit at each distinct x: max over a <= i of min over b >= i of the mean of a..b."""
    values = np.unique(x)
    weight = np.array([w[x == v].sum() for v in values])
    total = np.array([(w * y)[x == v].sum() for v in values])
    n = len(values)
    return values, np.array([max(min(total[a : b + 1].sum() / weight[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def make(rng, n=150):
    person = rng.integers(0, 24, n)
    x = rng.integers(0, 60, n) * 1.7 % 100
    y = np.clip(x * 0.6 + 10 + rng.normal(0, 12, n), 0, 100).round(2)
    return person, x, y, person % 2


def test_curves_equal_minimax(spark):
    person, x, y, fold = make(np.random.default_rng(2))
    df = spark.createDataFrame([("m", int(p), float(a), float(b), int(k)) for p, a, b, k in zip(person, x, y, fold)], "metric string, person int, x double, y double, fold int")
    got = {r["held"]: r for r in isotonic.curves(df, "x", "y", "person", ["metric"], 2).collect()}
    assert set(got) == {0, 1, -1}
    for held, r in got.items():
        use = fold != held
        _, inverse, counts = np.unique(person[use], return_inverse=True, return_counts=True)
        values, fit = minimax(x[use], y[use], 1 / counts[inverse])
        assert np.allclose(np.interp(values, r["knots_x"], r["knots_y"]), np.clip(fit, 0, 100), atol=1e-9)
        assert (np.diff(r["knots_x"]) > 0).all() and (np.diff(r["knots_y"]) >= -1e-12).all()


def test_strength_equals_plain_loop(spark):
    person, x, y, fold = make(np.random.default_rng(3), 200)
    df = spark.createDataFrame([("m", int(p), float(a), float(b), int(k)) for p, a, b, k in zip(person, x, y, fold)], "metric string, person int, x double, y double, fold int")
    table, _ = isotonic.select_strength(df, "x", "y", "person", ["metric"], (0.0, 0.25, 0.75))
    got = {r["strength"]: r for r in table.collect()}
    _, inverse, counts = np.unique(person, return_inverse=True, return_counts=True)
    w = 1 / counts[inverse] / len(counts)
    want = {}
    for s in (0.0, 0.25, 0.75):
        f = np.zeros(len(x))
        for k in (0, 1):
            use = fold != k
            _, inv, cnt = np.unique(person[use], return_inverse=True, return_counts=True)
            values, fit = minimax(x[use], y[use], 1 / cnt[inv])
            f[~use] = np.interp(x[~use], values, np.clip(fit, 0, 100))
        want[s] = w @ np.abs((1 - s) * x + s * f - y)
    assert all(abs(got[s]["mae"] - v) < 1e-9 for s, v in want.items())
    assert [s for s, r in got.items() if r["selected"]] == [min(want, key=lambda s: (round(want[s], 12), s))]


def test_split_families_and_bad_values_are_refused(spark):
    rows = [("m", 1, 10.0, 20.0, 0), ("m", 1, 11.0, 21.0, 1)]
    df = spark.createDataFrame(rows, "metric string, person int, x double, y double, fold int")
    with pytest.raises(ValueError):
        isotonic.curves(df, "x", "y", "person", ["metric"], 2)
    with pytest.raises(ValueError):
        isotonic.curves(df.where("fold = 0").withColumn("y", F.lit(101.0)), "x", "y", "person", ["metric"], 2)
