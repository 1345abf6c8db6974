"""Splits that keep class shares, and preprocessing fitted on the training part only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.columns import hash_order
from gneiss.operators.order import positions
from gneiss.operators.quantiles import quantiles


def stratified(df: DataFrame, key: str, target: str, parts: dict[str, float], folds: int = 5, seed: int = 42) -> DataFrame:
    """``part`` by exact shares within each class, and ``fold`` dealt in turn within each class.

    The order is a hash of the key, so a row's place doesn't depend on the
    order of the input. Rows without a class are left out.
    """
    df = df.where(F.col(target).isNotNull())
    sizes = df.groupBy(target).agg(F.count("*").alias("class_n"))
    ranked = positions(df, hash_order(key, seed=seed), F.col(key), by=[target], name="nth").join(sizes, target)
    ranked = ranked.withColumn("nth", F.col("nth") + 1).withColumn("place", (F.col("nth") - 1) / F.col("class_n")).drop("class_n")
    names, upto, part = list(parts), 0.0, None
    for name in names[:-1]:
        upto = round(upto + parts[name], 12)
        part = F.when(F.col("place") < upto, name) if part is None else part.when(F.col("place") < upto, name)
    part = F.lit(names[-1]) if part is None else part.otherwise(names[-1])
    return ranked.withColumn("part", part).withColumn("fold", ((F.col("nth") - 1) % folds).cast("int")).drop("nth", "place")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weights n / (classes * n of the class)."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("all_n"), F.count("*").alias("classes"))
    return counts.crossJoin(whole).select(target, "n", (F.col("all_n") / (F.col("classes") * F.col("n"))).alias("weight"))


def impute_median(fit: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values as the exact median of ``fit``; a column without any value stays missing."""
    long = fit.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")
    medians = {r.variable: r.q for r in quantiles(long, "value", [0.5], ["variable"]).collect()}  # a row for each column
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians.get(c)).cast("double")) for c in columns})


def standardize(fit: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1 on ``fit``; a constant column is only centred."""
    stats = fit.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def pool_rare(fit: DataFrame, df: DataFrame, column: str, least: int) -> DataFrame:
    """Levels with fewer than ``least`` rows in ``fit``, and levels unknown there, as one level; missing stays missing."""
    common = fit.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(column, F.lit(True).alias("is_common"))
    return df.join(common, column, "left").withColumn(column, F.when(F.col(column).isNotNull(), F.when(F.col("is_common"), F.col(column)).otherwise("__rare__"))).drop("is_common")


def polynomial(df: DataFrame, columns: Sequence[str], degree: int) -> DataFrame:
    """All products of the columns up to a degree, named by their factors."""
    terms = {"".join(t): reduce(lambda a, b: a * b, (F.col(c) for c in t)) for n in range(2, degree + 1) for t in combinations_with_replacement(columns, n)}
    return df.withColumns(terms)
