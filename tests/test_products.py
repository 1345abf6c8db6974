import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import products, screening

RNG = np.random.default_rng(41)


def test_correlations_of_many_columns_equal_numpy(spark):
    d, n = 120, 400
    x = RNG.normal(size=(n, 8)) @ RNG.normal(size=(8, d)) + RNG.normal(size=(n, d)) + 1e6 * (np.arange(d) == 5)
    x[:, 7] = 3.7
    x[:, 8] = np.nan
    gone = RNG.random((n, d)) < 0.1
    gone[:, :3] = False
    x[gone] = np.nan
    names = [f"v{i}" for i in range(d)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r.a, r.b): r for r in screening.correlations(df, names).collect()}
    assert len(got) == d * (d - 1) // 2
    for i, j in [(0, 1), (0, 2), (2, 5), (3, 9), (40, 110), (5, 118)]:
        own = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        r = got[names[i], names[j]]
        assert r.n == own.sum() and r.r == pytest.approx(np.corrcoef(x[own, i], x[own, j])[0, 1], abs=1e-8)
    assert got["v0", "v7"].r is None and got["v7", "v9"].r is None and got["v0", "v8"].n == 0 and got["v0", "v8"].r is None


def test_spread_only_outside_the_pair(spark):
    rows = [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 6.0), (4.0, None)]
    r = screening.correlations(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).first()
    assert r.r is None and r.n == 3
    empty = spark.createDataFrame([], "a double, b double")
    assert screening.correlations(empty, ["a", "b"]).collect() == [("a", "b", None, 0)]
    with pytest.raises(ValueError):
        products.matrix_sums(spark.range(1), ["id"] * 5000, dict)
    sums = products.matrix_sums(spark.range(10).withColumn("y", F.lit(2)), ["id", "y"], lambda x: {"s": x.T @ x})
    assert sums["s"].tolist() == [[285.0, 90.0], [90.0, 40.0]]
