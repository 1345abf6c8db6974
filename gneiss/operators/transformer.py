"""A column transformer fitted as one table: median imputation, scaling, pooled one-hot levels.

The state has a row for each numeric column and each kept level, for each fit.
Fits that differ only in their rows (folds) are one pass: rows are expanded to
the fits they belong to and summed before the shuffle. The state is saved as
any table, and applied in one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gneiss.operators.quantiles import quantiles

#: Rows of a state at most: each becomes an element of the feature array.
MAX_STATE = 10_000
#: Level of missing categories, and the one that rare and unknown levels go to.
MISSING, POOLED = "unknown", "pooled"


def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), by: Sequence[str] = (), least: int = 20) -> DataFrame:
    """State of each group of ``by`` (not null): ``column``, ``level`` (null: a number), ``n``, ``median``, ``mean``, ``sd``.

    Mean and population deviation are of the column with its median in place
    of missing values; a constant column has a deviation of 1, one without
    values a median of 0. Levels (missing ones are MISSING) have at least
    ``least`` rows; every category has a level POOLED for the others.
    """
    by = list(by)
    numbers = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numeric))).alias("x")).select(*by, "x.*")
    stats = numbers.groupBy(*by, "column").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    medians = quantiles(numbers, "value", [0.5], [*by, "column"]).select(*by, "column", F.col("q").alias("median"))
    s = stats.join(medians, [*by, "column"], "left").fillna(0.0, ["median", "m", "v"])
    share = F.col("known") / F.col("n")
    mean = share * F.col("m") + (1 - share) * F.col("median")
    s = s.withColumn("mean", mean)
    gap = lambda c: (F.col(c) - F.col("mean")) * (F.col(c) - F.col("mean"))
    var = share * (F.col("v") + gap("m")) + (1 - share) * gap("median")
    sd = F.when(var > 0, F.sqrt(var)).otherwise(1.0)
    state = s.select(*by, "column", F.lit(None).cast("string").alias("level"), "n", "median", "mean", sd.alias("sd"))
    if not categorical:
        return state
    names = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("level")) for c in categorical))).alias("x")).select(*by, "x.*")
    counts = names.groupBy(*by, "column", "level").agg(F.count("*").alias("n"))
    pooled = F.when(F.col("n") >= least, F.col("level")).otherwise(POOLED)
    kept = counts.groupBy(*by, "column", pooled.alias("level")).agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("double")
    # the pooled level is there even if no row needs it yet
    spare = counts.groupBy(*by, "column").agg(F.lit(POOLED).alias("level"), F.lit(0).cast("long").alias("n"))
    kept = kept.unionByName(spare).groupBy(*by, "column", "level").agg(F.sum("n").alias("n"))
    return state.unionByName(kept.select(*by, "column", "level", "n", none.alias("median"), none.alias("mean"), none.alias("sd")))


def rows_of(state: DataFrame) -> list[Row]:
    """The state of one fit in a fixed order, checked for its size."""
    found = state.limit(MAX_STATE + 1).collect()
    if len(found) > MAX_STATE:
        raise ValueError(f"a state of more than {MAX_STATE} rows")
    return sorted(found, key=lambda r: (r.level is not None, r.column, r.level or ""))


def names(state: Sequence[Row]) -> list[str]:
    return [r.column if r.level is None else f"{r.column}={r.level}" for r in state]


def features(state: Sequence[Row]) -> Column:
    """The feature array of a row, in the order of ``state`` (see :func:`rows_of`)."""
    levels: dict[str, list[str]] = {}
    for r in state:
        if r.level is not None and r.level != POOLED:
            levels.setdefault(r.column, []).append(r.level)

    def element(r: Row) -> Column:
        if r.level is None:
            return (F.coalesce(F.col(r.column).cast("double"), F.lit(r.median)) - F.lit(r.mean)) / F.lit(r.sd)
        own = F.coalesce(F.col(r.column).cast("string"), F.lit(MISSING))
        known = levels.get(r.column, [])
        hit = (own == r.level) if r.level != POOLED else ~own.isin(known) if known else F.lit(True)
        return hit.cast("double")

    return F.array(*map(element, state)).cast("array<double>")


def apply(df: DataFrame, state: Sequence[Row], name: str = "features") -> DataFrame:
    """``df`` with the feature array ``name``."""
    return df.withColumn(name, features(state))
