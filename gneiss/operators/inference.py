"""Statistical tests as aggregations and windows.

Series are ordered by an explicit ``row`` column; lags and ranks over a whole
table go by range partitions (``operators/order.py``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import order
from gneiss.sources.storage import materialize


def adjust_p(df: DataFrame) -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted values of ``name``, ``p``."""
    known = df.select("name", "p").where("p is not null")
    m = F.lit(known.count())
    ranked = order.positions(known, F.asc("p"), F.asc("name"), name="i").withColumn("i", F.col("i") + 1)
    upwards = order.running(ranked, [F.asc("i")], {"holm": (m - F.col("i") + 1) * F.col("p")}, how="max")
    both = order.running(upwards, [F.desc("i")], {"bh": m * F.col("p") / F.col("i")}, how="min")
    return both.select("name", "p", F.least("holm", F.lit(1.0)).alias("holm"), F.least("bh", F.lit(1.0)).alias("bh"))


def combined_p(df: DataFrame) -> DataFrame:
    """Fisher's combination of the p-values ``p`` of independent parts, and the least after Holm's adjustment: ``n``, ``fisher``, ``fisher_p``, ``holm_least``."""
    from gneiss.functions.distributions import chi2_upper

    r = df.where("p is not null").agg(F.count("*").alias("n"), (-2 * F.sum(F.log(F.greatest("p", F.lit(1e-300))))).alias("fisher"), F.min("p").alias("least")).first()
    row = (r.n, r.fisher, chi2_upper(r.fisher, 2 * r.n) if r.n else None, min(1.0, r.least * r.n) if r.n else None)
    return df.sparkSession.createDataFrame([row], "n long, fisher double, fisher_p double, holm_least double")


def average_ranks(df: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """``rank_avg``: ranks within small groups (blocks), ties averaged; for large ones see :func:`order.tie_ranks`."""
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn("rank_avg", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value) if descending else F.asc(value))) + (ties - 1) / 2)


def friedman(df: DataFrame) -> DataFrame:
    """Friedman chi-square (tie-corrected) and Iman-Davenport F of ``block``, ``model``, ``score``."""
    r = average_ranks(df, ["block"], "score", descending=True)
    sizes = r.agg(F.countDistinct("block").alias("n"), F.countDistinct("model").alias("k"))
    sums = r.groupBy("model").agg(F.sum("rank_avg").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("ssq"))
    ties = r.groupBy("block", "score").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n, k = F.col("n"), F.col("k")
    correction = 1 - F.col("ties") / (n * k * (k * k - 1))
    chi2 = (12.0 / (n * k * (k + 1)) * F.col("ssq") - 3 * n * (k + 1)) / correction
    t = sizes.crossJoin(sums).crossJoin(ties).select("n", "k", chi2.alias("chi2"))
    return t.withColumn("f", F.try_divide((n - 1) * F.col("chi2"), n * (k - 1) - F.col("chi2")))


def autocovariances(df: DataFrame, lags: int) -> DataFrame:
    """``n``, ``mean`` and sums ``g0`` .. ``g<lags>`` of products of the centred ``x`` and its lags, over ``row``."""
    known = df.select("row", "x").where("x is not null")
    mean = known.agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    centred = known.crossJoin(mean.select("mean")).withColumn("x", F.col("x") - F.col("mean"))
    sums = order.lag_products(centred, "row", "x", lags).select(*(F.get("sums", F.lit(k)).alias(f"g{k}") for k in range(lags + 1)))
    return mean.select("n", "mean").join(sums, how="left")  # one row


def newey_west(df: DataFrame, lags: int) -> DataFrame:
    """Long-run variance of ``x`` over ``row`` with Bartlett weights."""
    t = autocovariances(df, lags)
    total = F.col("g0") / F.col("n")
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}") / F.col("n")
    return t.select("n", total.alias("variance"))


def placements(counts: DataFrame, score: str) -> DataFrame:
    """From numbers of rows of both classes ``p``, ``q``: for each distinct score its rows of class 1 and 0 (``pos``, ``neg``) and their placements ``v1``, ``v0``.

    A placement is the share of the other class on the right side of the
    score (below for class 1, above for class 0), ties half.
    """
    values = counts.groupBy(score).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    upto = order.running(values, [F.asc(score)], {"__pos": F.col("pos"), "__neg": F.col("neg")})
    whole = counts.agg(F.sum("p").alias("__m"), F.sum("q").alias("__n"))
    below, above = F.col("__neg") - F.col("neg") / 2, F.col("__m") - F.col("__pos") + F.col("pos") / 2
    return upto.crossJoin(whole).select(score, "pos", "neg", F.try_divide(below, F.col("__n").cast("double")).alias("v1"), F.try_divide(above, F.col("__m").cast("double")).alias("v0"))


def weighted_variance(x: Column, n: Column) -> Column:
    """Sample variance of values that stand for ``n`` rows each."""
    total, sums = F.sum(n), F.sum(n * x)
    return F.try_divide(F.sum(n * x * x) - F.try_divide(sums * sums, total), total - 1)


def delong(df: DataFrame) -> DataFrame:
    """AUCs of two scores ``s1``, ``s2`` of the same rows, with the variance of their difference and z.

    Rows of equal scores and class are one row with a number; placements come
    from the distinct values of each score.
    """
    rows = df.where("y is not null and s1 is not null and s2 is not null").select("y", "s1", "s2")
    counts = materialize(rows.groupBy("y", "s1", "s2").agg(F.count("*").alias("n")), "equal_scores")
    placed = counts
    for i in (1, 2):
        weighed = counts.select(f"s{i}", (F.col("y") * F.col("n")).alias("p"), ((1 - F.col("y")) * F.col("n")).alias("q"))
        found = placements(weighed, f"s{i}").select(f"s{i}", F.col("v1").alias(f"v1_{i}"), F.col("v0").alias(f"v0_{i}"))
        placed = placed.join(found, f"s{i}").withColumn(f"v{i}", F.when(F.col("y") == 1, F.col(f"v1_{i}")).otherwise(F.col(f"v0_{i}")))
    n = F.col("n")
    mean = lambda c: F.sum(n * F.col(c)) / F.sum(n)
    t = placed.groupBy("y").agg(mean("v1").alias("a1"), mean("v2").alias("a2"), weighted_variance(F.col("v1") - F.col("v2"), n).alias("d"), F.sum(n).alias("n"))
    out = t.agg(F.max(F.when(F.col("y") == 1, F.col("a1"))).alias("auc1"), F.max(F.when(F.col("y") == 1, F.col("a2"))).alias("auc2"), F.sum(F.col("d") / F.col("n")).alias("variance"))
    return out.select("auc1", "auc2", "variance", F.try_divide(F.col("auc1") - F.col("auc2"), F.sqrt("variance")).alias("z"))


def cliff_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cliff's delta of column ``x`` of two tables, from counts of distinct values."""
    u = a.where("x is not null").select("x", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.where("x is not null").select("x", F.lit(0).alias("a"), F.lit(1).alias("b")))
    values = u.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    t = order.running(values, [F.col("x")], {"upto": F.col("b")}).withColumn("below", F.col("upto") - F.col("b")).agg(F.sum(F.col("a") * (2 * F.col("below") + F.col("b"))).alias("u2"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    return t.select(F.try_divide(F.col("u2") - F.col("n") * F.col("m"), (F.col("n") * F.col("m")).cast("double")).alias("delta"))


def cohen_paired(df: DataFrame) -> DataFrame:
    """Mean difference of ``a``, ``b`` over its sample deviation."""
    d = F.col("a") - F.col("b")
    return df.agg(F.avg(d).alias("mean"), F.stddev(d).alias("sd"), F.count(d).alias("n")).withColumn("d", F.try_divide("mean", "sd"))


def diebold_mariano(df: DataFrame, h: int = 1, power: int = 2) -> DataFrame:
    """Diebold-Mariano statistic of errors ``e1``, ``e2`` under the loss |e|^power, ``h`` steps ahead, with the small-sample factor.

    The variance of the mean takes the autocovariances of the h - 1 nearest
    lags; no statistic where their sum isn't positive.
    """
    t = autocovariances(df.select("row", (F.pow(F.abs("e1"), power) - F.pow(F.abs("e2"), power)).alias("x")), h - 1)
    n = F.col("n")
    variance = (F.col("g0") + reduce(lambda a, b: a + b, (2 * F.col(f"g{k}") for k in range(1, h)), F.lit(0.0))) / n / n
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return t.select("n", "mean", F.when(variance > 0, F.col("mean") / F.sqrt(variance) * factor).alias("dm"))


def giacomini_white(df: DataFrame) -> DataFrame:
    """Conditional predictive ability with instruments (1, last loss difference): n * g' S^-1 g."""
    d = df.select("row", (F.col("e1") * F.col("e1") - F.col("e2") * F.col("e2")).alias("x"))
    d = order.lagged(d, "row", "x", [1]).withColumnRenamed("lag_1", "z").where("z is not null")
    a, b = F.col("x"), F.col("x") * F.col("z")
    t = d.agg(F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.avg(a * a).alias("s11"), F.avg(a * b).alias("s12"), F.avg(b * b).alias("s22"), F.count("*").alias("n"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    q = F.col("m1") * F.col("m1") * F.col("s22") - 2 * F.col("m1") * F.col("m2") * F.col("s12") + F.col("m2") * F.col("m2") * F.col("s11")
    return t.select("n", F.try_divide(F.col("n") * q, det).alias("gw"))


def wilcoxon(df: DataFrame) -> DataFrame:
    """Signed-rank sums of ``a`` - ``b``; zero differences are ranked and split between the sums."""
    d = order.tie_ranks(df.select(F.abs(F.col("a") - F.col("b")).alias("m"), F.signum(F.col("a") - F.col("b")).alias("g")).where("m is not null"), "m")
    up = F.sum(F.when(F.col("g") > 0, F.col("rank_avg")).when(F.col("g") == 0, F.col("rank_avg") / 2).otherwise(0.0))
    down = F.sum(F.when(F.col("g") < 0, F.col("rank_avg")).when(F.col("g") == 0, F.col("rank_avg") / 2).otherwise(0.0))
    t = d.agg(up.alias("up"), down.alias("down"), F.count("*").alias("n"), F.sum(F.when(F.col("g") == 0, 1).otherwise(0)).alias("zeros"))
    return t.select("n", "zeros", F.least("up", "down").alias("w"), (F.col("up") - F.col("down")).alias("balance"))


def ljung_box(df: DataFrame, lags: int) -> DataFrame:
    """Ljung-Box Q of ``x`` over ``row``."""
    q = F.lit(0.0)
    for k in range(1, lags + 1):
        q = q + F.pow(F.try_divide(f"g{k}", "g0"), 2) / (F.col("n") - k)
    return autocovariances(df, lags).select("n", (F.col("n") * (F.col("n") + 2) * q).alias("q"))


def autocorrelations(df: DataFrame, lags: int) -> DataFrame:
    """``lag``, ``r``: autocorrelation of ``x`` over ``row``."""
    t = autocovariances(df, lags)
    cells = F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(f"g{k}", "g0").alias("r")) for k in range(1, lags + 1)))
    return t.select(F.explode(cells).alias("c")).select("c.*")


def jarque_bera(df: DataFrame) -> DataFrame:
    """Population skewness, excess kurtosis and the Jarque-Bera statistic of ``x``."""
    t = df.agg(F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurtosis"), F.count("x").alias("n"))
    return t.withColumn("jb", F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurtosis") * F.col("kurtosis") / 4))


def scaling_exponent(df: DataFrame) -> DataFrame:
    """Slope, intercept and R2 of log(time) on log(size)."""
    x, y = F.log(F.col("size").cast("double")), F.log(F.col("time").cast("double"))
    return df.where("size > 0 and time > 0").agg(F.regr_slope(y, x).alias("exponent"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def clark_west(df: DataFrame, lags: int) -> DataFrame:
    """Clark-West adjusted loss difference of ``y``, ``restricted``, ``general`` over ``row``: mean and z with Newey-West variance."""
    f = F.pow(F.col("y") - F.col("restricted"), 2) - (F.pow(F.col("y") - F.col("general"), 2) - F.pow(F.col("restricted") - F.col("general"), 2))
    x = df.select("row", f.alias("x"))
    t = x.agg(F.avg("x").alias("mean")).crossJoin(newey_west(x, lags))
    return t.select("n", "mean", F.try_divide("mean", F.sqrt(F.col("variance") / F.col("n"))).alias("cw"))
