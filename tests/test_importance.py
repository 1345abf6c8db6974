import numpy as np
import pytest

from gneiss.operators import importance

RNG = np.random.default_rng(51)


def test_additive_function_gives_its_variance_shares(spark):
    x = RNG.random((6000, 3))
    # steps that a tree can match: variances 4 (1/4), 1 (1/4), 0 and an interaction
    y = 4.0 * (x[:, 0] > 0.5) + 2.0 * (x[:, 1] > 0.5)
    rows = spark.createDataFrame([tuple(map(float, (*a, b))) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    ranges = dict.fromkeys("abc", (0.0, 1.0))
    got = importance.variance_shares(importance.forest_of_runs(rows, list("abc"), "y", trees=5, depth=5), ranges)
    assert got["a",] == pytest.approx(0.8, abs=0.03) and got["b",] == pytest.approx(0.2, abs=0.03) and got["c",] == pytest.approx(0, abs=0.01)
    assert sum(got.values()) == pytest.approx(1, abs=1e-6) or got["a", "b"] == pytest.approx(0, abs=0.02)
    crossed = spark.createDataFrame([tuple(map(float, (*a, (a[0] > 0.5) == (a[1] > 0.5)))) for a in x], "a double, b double, c double, y double")
    got = importance.variance_shares(importance.forest_of_runs(crossed, list("abc"), "y", trees=5, depth=6), ranges)
    assert got["a", "b"] > 0.85 and sum(got.values()) <= 1 + 1e-9


def test_shares_equal_a_grid(spark):
    x = RNG.random((500, 2))
    rows = spark.createDataFrame([tuple(map(float, (*a, np.sin(5 * a[0]) + a[0] * a[1]))) for a in x], "a double, b double, y double")
    model = importance.forest_of_runs(rows, ["a", "b"], "y", trees=1, depth=5)
    got = importance.variance_shares(model, {"a": (0.0, 1.0), "b": (0.0, 1.0)})
    n = 200
    g = (np.arange(n) + 0.5) / n
    grid = spark.createDataFrame([(float(a), float(b)) for a in g for b in g], "a double, b double")
    f = np.array([r.prediction for r in model.transform(grid).collect()]).reshape(n, n)
    assert got["a",] == pytest.approx(f.mean(1).var() / f.var(), abs=0.01) and got["b",] == pytest.approx(f.mean(0).var() / f.var(), abs=0.01)
    constant = spark.createDataFrame([(0.1, 0.2, 1.0), (0.5, 0.5, 1.0)], "a double, b double, y double")
    assert set(importance.variance_shares(importance.forest_of_runs(constant, ["a", "b"], "y", trees=2), {"a": (0.0, 1.0), "b": (0.0, 1.0)}).values()) == {0.0}
