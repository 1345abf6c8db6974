"""Metrics of scored rows: ranking, thresholds, calibration, regression.

A scored table has ``y`` (0/1) and ``s``; rows with either missing are left
out. Everything starts from one row for each distinct score, so running sums
are over distinct scores and ties need no care.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators import order


def _keys(by: str | Sequence[str] | None) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def score_table(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Counts of each distinct score, with running true and false positives from the top."""
    keys = _keys(by)
    rows = df.where("y is not null and s is not null").groupBy(*keys, "s").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    sums = order.running(rows, [F.desc("s")], {"tp": F.col("pos"), "upto": F.col("n")}, keys).withColumn("fp", F.col("upto") - F.col("tp")).drop("upto")
    whole = rows.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("n").alias("all_n"))
    return sums.join(whole, keys) if keys else sums.crossJoin(whole)


def ranking(df: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """AUC (by ranks, ties half) and average precision (step sum, ties grouped)."""
    keys = _keys(by)
    t = score_table(df, by).withColumn("neg", F.col("n") - F.col("pos"))
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = t.groupBy(*keys).agg(F.max("p").alias("p"), F.max("all_n").alias("n"), auc.alias("u"), ap.alias("ap"))
    return out.select(*keys, "n", "p", F.try_divide("u", (F.col("p") * (F.col("n") - F.col("p"))).cast("double")).alias("auc"), F.try_divide("ap", F.col("p").cast("double")).alias("ap"))


def confusion(df: DataFrame, threshold: float) -> DataFrame:
    """Confusion counts at s >= threshold and the rates from them; an empty denominator gives 0."""
    y, hit = F.col("y") == 1, F.col("s") >= threshold
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    t = df.where("y is not null and s is not null").agg(count(y & hit).alias("tp"), count(~y & hit).alias("fp"), count(y & ~hit).alias("fn"), count(~y & ~hit).alias("tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select(
        "tp", "fp", "fn", "tn", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
        safe(tn, tn + fp).alias("specificity"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def best_thresholds(df: DataFrame, cost_fn: float = 10.0, by: str | Sequence[str] | None = None) -> DataFrame:
    """Thresholds of least cost (cost_fn * FN + FP), largest Youden J and largest F1.

    Ties go to the larger score. Calling nothing positive is also weighed for
    the cost; its threshold is null.
    """
    keys = _keys(by)
    t = score_table(df, keys)
    cost = cost_fn * (F.col("p") - F.col("tp")) + F.col("fp")
    j = F.try_divide("tp", "p") - F.try_divide("fp", F.col("all_n") - F.col("p"))
    f1 = F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p"))
    best = t.groupBy(*keys).agg(
        F.min(F.struct(cost.alias("v"), (-F.col("s")).alias("m"))).alias("c"),
        F.max(F.struct(j.alias("v"), F.col("s").alias("m"))).alias("j"),
        F.max(F.struct(f1.alias("v"), F.col("s").alias("m"))).alias("f"),
        (F.max("p") * cost_fn).alias("none"),
    )
    return best.select(
        *keys, F.when(F.col("c.v") <= F.col("none"), -F.col("c.m")).alias("cost_threshold"), F.least("c.v", "none").alias("cost"), F.col("j.m").alias("youden_threshold"), F.col("j.v").alias("youden"),
        F.col("f.m").alias("f1_threshold"), F.col("f.v").alias("f1"),
    )


def curves(df: DataFrame) -> DataFrame:
    """ROC and precision-recall points, one for each distinct score."""
    return score_table(df).select(
        "s", F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", F.col("all_n") - F.col("p")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision")
    )


def equal_width_bin(s: Column, bins: int) -> Column:
    """Number of inner edges i/bins that are at most the score."""
    return F.size(F.filter(F.array(*(F.lit(i / bins) for i in range(1, bins))), lambda e: e <= s))


def calibration(df: DataFrame, bins: int = 15) -> DataFrame:
    """Reliability table over equal-width bins."""
    rows = df.where("y is not null and s is not null").groupBy(equal_width_bin(F.col("s"), bins).alias("bin"))
    return rows.agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("rate"))


def calibration_equal_count(df: DataFrame, row: str, bins: int = 15) -> DataFrame:
    """Reliability table over bins of equally many rows, in order of score and then row."""
    known = order.equal_count_bins(df.where("y is not null and s is not null"), bins, F.col("s"), F.col(row))
    return known.groupBy("bin").agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("rate"))


def expected_error(table: DataFrame) -> DataFrame:
    """Expected calibration error of a reliability table."""
    return table.agg(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))).alias("e"), F.sum("n").alias("n")).select(F.try_divide("e", F.col("n").cast("double")).alias("ece"))


def regression(df: DataFrame) -> DataFrame:
    """RMSE, MAE, R2 and Brier score (score limited to [0, 1])."""
    known = df.where("y is not null and s is not null")
    e = F.col("y") - F.col("s")
    clipped = F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)) - F.col("y")
    t = known.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y").alias("v"), F.avg(clipped * clipped).alias("brier"))
    return t.select(F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("mse", F.nullif("v", F.lit(0.0)))).alias("r2"), "brier")
