import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import order, replicates

RNG = np.random.default_rng(17)


def auc(y, s, w):
    p, n = w * (y == 1), w * (y == 0)
    wins = (s[:, None] > s[None, :]) + 0.5 * (s[:, None] == s[None, :])
    return (p[:, None] * n[None, :] * wins).sum() / (p.sum() * n.sum())


@pytest.fixture(scope="module")
def rows(spark):
    y = RNG.integers(0, 2, 700)
    s = (y * 0.4 + RNG.random(700)).round(1)
    data = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s, strict=True))]
    return spark.createDataFrame([*data, (900, None, 0.5), (901, 1, None)], "id long, y int, s double")


def test_replicates_equal_pairs(spark, rows):
    weights = F.concat(F.array(F.lit(1)), replicates.draws("id", 9), replicates.leave_outs("id", 5))
    known = rows.where("id < 700").withColumn("w", weights).orderBy("id").toPandas()
    w = np.array(known.w.tolist(), float)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = dict(replicates.replicate_auc(rows, weights).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 15
    for r in range(15):
        assert got[r] == pytest.approx(auc(known.y.to_numpy(), known.s.to_numpy(), w[:, r]))
    # counts are Poisson draws of mean 1; every row is left out once
    assert w[:, 1:10].mean() == pytest.approx(1, abs=0.05) and w[:, 1:10].var() == pytest.approx(1, abs=0.1)
    assert (w[:, 10:].sum(axis=1) == 4).all()
    means = {(r.y, r.replicate): r["mean"] for r in replicates.replicate_means(rows.where("y is not null"), "s", weights, "y").collect()}
    assert means[1, 3] == pytest.approx((w[:, 3] * known.s * (known.y == 1)).sum() / (w[:, 3] * (known.y == 1)).sum())


def test_interval_covers_and_is_as_wide_as_theory(rows):
    point, low, high = replicates.auc_interval(rows, "id", 300, 40)
    assert low < point < high
    known = rows.where("id < 700").toPandas()
    a, m, n = point, (known.y == 1).sum(), (known.y == 0).sum()
    se = np.sqrt((a * (1 - a) + (m - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (m * n))
    assert (high - low) / (2 * 1.96 * se) == pytest.approx(1, abs=0.2)


def test_one_class_and_no_rows(spark, rows):
    assert np.isnan(replicates.auc_interval(rows.where("y = 1"), "id", 10, 5)[0])
    assert replicates.replicate_auc(rows.where("false"), replicates.draws("id", 3)).count() == 0


@pytest.mark.parametrize(("block", "window", "least"), [(10, 7, None), (10, 8, 3), (5, 9, 1), (100_000, 40, None)])
def test_rolling_equals_pandas(spark, monkeypatch, block, window, least):
    monkeypatch.setattr(order, "BLOCK", block)
    data = [(i, g, None if RNG.random() < 0.1 else float(RNG.normal())) for g, n in (("a", 83), ("b", 31), ("c", 2)) for i in range(n)]
    got = order.rolling(spark.createDataFrame(data, "i int, g string, x double"), [F.desc("i")], {"m": F.col("x")}, window, least, by=["g"]).toPandas()
    assert len(got) == len(data)
    for _, own in got.groupby("g"):
        own = own.sort_values("i", ascending=False).reset_index(drop=True)
        want = own.x.rolling(window, center=True, min_periods=window if least is None else least).mean()
        assert np.allclose(own.m.astype(float), want, equal_nan=True)
    with pytest.raises(ValueError):
        order.rolling(spark.range(1).toDF("i"), [F.col("i")], {"m": F.col("i")}, 2 * block + 2)


def test_wide_rolling_means_sum_each_row_twice(spark):
    # a frame that is summed anew for each of its 20,000 rows would read 400 million pairs of them, and nothing may be lost in differences of running sums
    x = [1e17 if i == 5 else float("inf") if i == 19_000 else float(i % 7) for i in range(20_000)]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    frames = lambda: order.rolling(df, [F.col("i")], {"m": F.col("x")}, 2000)
    got = {r.i: r.m for r in frames().select("i", "m").collect()}
    for i in (1000, 1004, 1005, 1006, 3000, 7777, 12_345, 17_999, 18_001):
        assert got[i] == pytest.approx(np.mean(x[i - 1000 : i + 1000])), i
    assert got[999] is None and got[19_001] is None and got[18_000] == pytest.approx(np.mean(x[17_000:19_000])) and got[18_001] == float("inf")
    plan = frames()._jdf.queryExecution().optimizedPlan().toString()
    framed = re.findall(r"specifiedwindowframe\(RowFrame, ([^,]+), ([^)]+(?:\(\))?)\)", plan)
    # frames of one row or from an end of the partition, none that slides
    assert framed and not [f for f in framed if f[0] != f[1] and "unbounded" not in f[0]], framed
