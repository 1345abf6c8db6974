"""Screening of variables: information, stability, redundancy.

Tables of many variables are handled in the long form (variable, value), so a
screen is one job whatever the number of variables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import products
from gneiss.operators.graph import connected_components
from gneiss.operators.order import running
from gneiss.operators.quantiles import quantiles


def long_form(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """(variable, value) rows of the columns, missing values included."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(*keep, cells.alias("cell")).select(*keep, "cell.*")


def missingness(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Target rate with and without a value, and the 2x2 chi-square with continuity correction.

    The correction is at most the deviation itself; a table with an empty
    margin has no statistic.
    """
    cells = long_form(df, columns, target).groupBy("variable").agg(
        F.sum(F.when(F.col("value").isNull() & (F.col(target) == 1), 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("value").isNull() & (F.col(target) == 0), 1).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("value").isNotNull() & (F.col(target) == 1), 1).otherwise(0)).alias("c"),
        F.sum(F.when(F.col("value").isNotNull() & (F.col(target) == 0), 1).otherwise(0)).alias("d"),
    )
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    margins = (F.col("a") + F.col("b")).cast("double") * (F.col("c") + F.col("d")) * (F.col("a") + F.col("c")) * (F.col("b") + F.col("d"))
    gap = F.abs(F.col("a").cast("double") * F.col("d") - F.col("b").cast("double") * F.col("c"))
    chi2 = F.try_divide(n * F.pow(F.greatest(gap - n / 2, F.lit(0.0)), 2), F.nullif(margins, F.lit(0.0)))
    return cells.select(
        "variable", "a", "b", "c", "d", chi2.alias("chi2"), F.try_divide(F.col("a"), F.nullif(F.col("a") + F.col("b"), F.lit(0))).alias("rate_missing"),
        F.try_divide(F.col("c"), F.nullif(F.col("c") + F.col("d"), F.lit(0))).alias("rate_present"),
    )


def auc_by_variable(df: DataFrame, columns: Sequence[str], target: str, least: int = 100) -> DataFrame:
    """Rank AUC of each variable alone, turned so that it is at least 0.5, with coverage and correlation."""
    long = long_form(df, columns, target)
    sizes = long.groupBy("variable").agg(F.count("*").alias("all_rows"))
    known = long.where(F.col("value").isNotNull() & F.col(target).isNotNull())
    # ties first: one row for each value, so the window runs over distinct values
    values = known.groupBy("variable", "value").agg(F.count("*").alias("n"), F.sum(target).alias("pos"))
    upto = running(values, [F.col("value")], {"upto": F.col("n")}, ["variable"])
    ranked = upto.withColumn("rank_sum", F.col("pos") * (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2))
    x, y = F.col("value"), F.col("pos") / F.col("n")
    n, p = F.sum("n"), F.sum("pos")
    sx, sxx, sxy = F.sum(x * F.col("n")), F.sum(x * x * F.col("n")), F.sum(x * F.col("pos"))
    out = ranked.groupBy("variable").agg(n.alias("n"), p.alias("pos"), F.sum("rank_sum").alias("r"), sx.alias("sx"), sxx.alias("sxx"), sxy.alias("sxy"))
    neg = F.col("n") - F.col("pos")
    auc = F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2, F.nullif((F.col("pos") * neg).cast("double"), F.lit(0.0)))
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("pos") - F.col("pos") * F.col("pos") / F.col("n"))
    corr = F.try_divide(F.col("sxy") - F.col("sx") * F.col("pos") / F.col("n"), F.sqrt(F.nullif(F.greatest(spread, F.lit(0.0)), F.lit(0.0))))
    return (
        out.where(F.col("n") >= least)
        .join(sizes, "variable")
        .select("variable", F.greatest(auc, 1 - auc).alias("auc"), corr.alias("corr"), (F.col("n") / F.col("all_rows")).alias("coverage"), "n")
    )


def separation(df: DataFrame, column: str, target: str, edges: Sequence[float]) -> DataFrame:
    """Weighted mean distance (in points) of group rates from the overall rate; groups are bins and missing."""
    from gneiss.operators.collapse import bucket

    group = F.coalesce(bucket(F.col(column).cast("double"), edges), F.lit(-1))
    rates = df.groupBy(group.alias("bin")).agg(F.count("*").alias("n"), F.sum(target).alias("pos"))
    whole = rates.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    gap = F.col("n") / F.col("all_n") * F.abs(F.col("pos") / F.col("n") - F.col("all_pos") / F.col("all_n")) * 100
    return rates.crossJoin(whole).agg(F.lit(column).alias("variable"), F.count("*").alias("bins"), F.sum(gap).alias("separation"))


def psi(train: DataFrame, test: DataFrame, columns: Sequence[str], bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index of each variable over the train table's quantile bins.

    Bins are [lo, hi) between distinct quantiles, the outer ones open; empty
    shares count as ``eps``; missing values are left out.
    """
    known = long_form(train, columns).where("value is not null")
    edges = quantiles(known, "value", [i / bins for i in range(bins + 1)], ["variable"]).groupBy("variable").agg(F.collect_set("q").alias("edges"))
    # inner edges only: the outer bins are open
    edges = edges.select("variable", F.array_sort(F.array_distinct("edges")).alias("edges")).select("variable", F.expr("slice(edges, 2, greatest(size(edges) - 2, 0))").alias("edges"))
    both = known.withColumn("side", F.lit("p")).unionByName(long_form(test, columns).where("value is not null").withColumn("side", F.lit("q")))
    # a bounded number of edges for each variable, so the join side is small; the planner decides
    binned = both.join(edges, "variable").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    counts = binned.groupBy("variable", "bin").agg(F.sum((F.col("side") == "p").cast("int")).alias("p"), F.sum((F.col("side") == "q").cast("int")).alias("q"))
    whole = Window.partitionBy("variable")
    share = counts.select(
        "variable",
        F.greatest(F.try_divide("p", F.sum("p").over(whole)), F.lit(eps)).alias("p"),
        F.greatest(F.try_divide("q", F.sum("q").over(whole)), F.lit(eps)).alias("q"),
    )
    return share.groupBy("variable").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def ks(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of each variable; missing values are left out."""
    a = long_form(train, columns).where("value is not null").groupBy("variable", "value").agg(F.count("*").alias("a"), F.lit(0).cast("long").alias("b"))
    b = long_form(test, columns).where("value is not null").groupBy("variable", "value").agg(F.lit(0).cast("long").alias("a"), F.count("*").alias("b"))
    both = a.unionByName(b).groupBy("variable", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = running(both, [F.col("value")], {"upto_a": F.col("a"), "upto_b": F.col("b")}, ["variable"])
    whole = both.groupBy("variable").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    gap = F.abs(F.try_divide("upto_a", "all_a") - F.try_divide("upto_b", "all_b"))
    return sums.join(whole, "variable").select("variable", gap.alias("gap")).groupBy("variable").agg(F.max("gap").alias("ks"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over rows where both are known; constant columns have none."""
    return df.sparkSession.createDataFrame(products.correlations(df, columns), "a string, b string, r double, n long")


def equivalence_groups(pairs: DataFrame, coverage: DataFrame, over: float = 0.95) -> DataFrame:
    """Groups of variables that are correlated over a limit, each with its survivor.

    The survivor has the largest coverage, then the shortest name, then the
    first in the alphabet.
    """
    edges = pairs.where(F.abs("r") > over).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = connected_components(edges).withColumnRenamed("node", "variable").join(coverage, "variable")
    order = Window.partitionBy("component").orderBy(F.desc("coverage"), F.length("variable"), "variable")
    return groups.withColumn("survivor", F.first("variable").over(order)).select("variable", "component", "survivor")
