import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import quantiles as Q

PROBS = [0.0, 0.013, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("accuracy", [5, 1000])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    parts = {"a": rng.normal(size=1501), "b": rng.integers(0, 4, 700).astype(float), "c": np.array([2.5]), "d": np.repeat([1.0, 9.0], [5, 2000])}
    rows = [(g, float(v)) for g, x in parts.items() for v in x] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.p): r.q for r in Q.quantiles(df, "x", PROBS, ["g"], accuracy).collect()}
    assert got.keys() == {(g, p) for g in parts for p in PROBS}
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(parts[g], p), abs=1e-12)
    whole = {r.p: r.q for r in Q.quantiles(df, "x", PROBS, accuracy=accuracy).collect()}
    assert whole == pytest.approx({p: np.quantile(np.concatenate(list(parts.values())), p) for p in PROBS})


def test_missed_brackets_are_made_whole(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    real, margins = Q._selected, []

    def narrow(rows, probs, by, margin, accuracy):
        margins.append(margin)
        # the first attempt is bracketed around another quantile
        return real(rows, probs, by, margin, accuracy) if margin == 1 else real(rows, probs, by, margin, accuracy).withColumn("q", F.lit(None).cast("double"))

    monkeypatch.setattr(Q, "_selected", narrow)
    assert Q.quantiles(df, "x", [0.5]).first().q == 499.5 and margins == [2 / Q.ACCURACY, 1.0]


def test_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert Q.quantiles(empty, "x", [0.5]).count() == 0 and Q.quantiles(empty, "x", [0.5], ["g"]).count() == 0
