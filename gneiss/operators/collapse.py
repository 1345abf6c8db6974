"""One-to-many history to one row for each key, and descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.quantiles import quantiles, wide

STATS = ("mean", "max", "min", "sum")


def _stat(name: str, c: Column) -> Column:
    # an all-missing group sums to 0, its other statistics are missing
    return {"mean": F.avg(c), "max": F.max(c), "min": F.min(c), "sum": F.coalesce(F.sum(c), F.lit(0))}[name]


def levels(df: DataFrame, column: str, most: int = 200) -> list[str]:
    """Distinct values of a category in order; more than ``most`` is an error, as each becomes a column."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return found


def summarize(df: DataFrame, key: str, prefix: str, numeric: Sequence[str], categories: dict[str, Sequence[str]] | Sequence[str] = (), stats: Sequence[str] = STATS) -> DataFrame:
    """One row for each key: statistics of numbers, mean and sum of one-hot categories, and the count.

    Rows with a missing key are dropped. A missing category is zero in every
    indicator and stays in the denominator of the mean. Everything is one
    grouped aggregation with partial sums before its only shuffle.
    """
    if not isinstance(categories, dict):
        categories = {c: levels(df, c) for c in categories}
    out = [_stat(s, F.col(c)).alias(f"{prefix}_{c}_{s}".upper()) for c in numeric for s in stats]
    for c, values in categories.items():
        for v in values:
            on = F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
            out += [F.avg(on).alias(f"{prefix}_{c}_{v}_mean".upper()), F.sum(on).alias(f"{prefix}_{c}_{v}_sum".upper())]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*out, F.count("*").alias(f"{prefix}_COUNT".upper()))


def two_hop(child: DataFrame, bridge: DataFrame, child_key: str, root_key: str, first: str, second: str, numeric: Sequence[str]) -> DataFrame:
    """Collapse grandchildren: child rows to one row for each bridge row, those to one for each root key."""
    near = summarize(child, child_key, first, numeric)
    wide = bridge.select(child_key, root_key).join(near, child_key, "left")
    return summarize(wide, root_key, second, [c for c in near.columns if c != child_key], stats=("mean", "sum"))


def profile(df: DataFrame, key: str, time: str, universe: DataFrame) -> DataFrame:
    """Rows, entities, rows an entity (median, 95th percentile, most), share of the universe covered, depth."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(time).alias("oldest"))
    seen = per.join(universe.select(key).distinct().withColumn("known", F.lit(1)), key, "left")
    size = universe.select(key).distinct().agg(F.count("*").alias("universe"))
    out = seen.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("entities"),
        F.percentile("n", F.lit(0.5)).alias("median_rows"),
        F.percentile("n", F.lit(0.95)).alias("p95_rows"),
        F.max("n").alias("max_rows"),
        F.sum("known").alias("covered"),
        F.abs(F.min("oldest")).alias("depth"),
    )
    return out.crossJoin(size).withColumn("coverage", F.col("covered") / F.col("universe"))


def missing_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count and share of each column, in one pass."""
    sums = df.agg(F.count("*").alias("n"), *(F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return sums.selectExpr("n", f"stack({len(columns)}, {pairs}) as (variable, n_missing)").selectExpr(
        "variable", "coalesce(n_missing, 0) as n_missing", "coalesce(100.0d * n_missing / nullif(n, 0), 0) as pct_missing"
    )


def frequencies(df: DataFrame, column: str, with_missing: bool = False) -> DataFrame:
    """Count and share of each value; missing values count only when asked for."""
    rows = df if with_missing else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(rows.agg(F.count("*").alias("all_rows"))).selectExpr(column, "n", "n / all_rows as share")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts by two variables, 0 where a pair doesn't occur."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return wide.select(row, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{column}_{v}") for v in values))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, quartiles, range and bias-corrected skewness of each column."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")
    x = F.col("value")
    stats = long.groupBy("variable").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"), F.skewness(x).alias("g1"))
    marks = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quarters = wide(long, "value", marks, ["variable"])
    adjusted = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2)).alias("skew")
    return stats.join(quarters, "variable", "left").select("variable", "n", "mean", "sd", "low", *marks, "high", adjusted, F.try_divide("high", "median").alias("extremeness"))


def narrowed(df: DataFrame) -> DataFrame:
    """``df`` with whole-number columns cast to the narrowest type that holds all their values, and doubles that floats hold exactly as floats.

    One pass finds the ranges; columns without values become the narrowest.
    """
    whole = [c for c, t in df.dtypes if t in ("bigint", "int", "smallint")]
    doubles = [c for c, t in df.dtypes if t == "double"]
    if not whole + doubles:
        return df
    exact = lambda c: F.coalesce(F.bool_and((F.col(c) == F.col(c).cast("float").cast("double")) | F.isnan(c)), F.lit(True))
    r = df.agg(*(f(c).cast("long").alias(f"{n}_{c}") for c in whole for n, f in (("low", F.min), ("high", F.max))), *(exact(c).alias(f"exact_{c}") for c in doubles)).first()

    def width(c: str) -> str:
        low, high = r[f"low_{c}"] or 0, r[f"high_{c}"] or 0
        return next((name for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)) if low >= -(2 ** (bits - 1)) and high < 2 ** (bits - 1)), "bigint")

    return df.withColumns({c: F.col(c).cast(width(c)) for c in whole} | {c: F.col(c).cast("float") for c in doubles if r[f"exact_{c}"]})


def without_constant(df: DataFrame, least: float = 0.05) -> DataFrame:
    """``df`` without columns of one value at most and those known in under a share of ``least`` of the rows; an empty table keeps all."""
    spread = lambda c: (F.min(F.col(f"`{c}`").cast("string")), F.max(F.col(f"`{c}`").cast("string")), F.count(F.col(f"`{c}`")))
    r = df.agg(F.count("*").alias("n"), *(x.alias(f"{k}_{i}") for i, c in enumerate(df.columns) for k, x in enumerate(spread(c)))).first()
    gone = [c for i, c in enumerate(df.columns) if r.n and (r[f"0_{i}"] == r[f"1_{i}"] or r[f"2_{i}"] < least * r.n)]
    return df.drop(*gone)


def duplicate_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows that repeat an earlier row on the columns."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("share", 1 - F.try_divide("n_distinct", "n_rows"))


def mode_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each column (as text) and its share of the non-missing rows."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    counts = long.where("value is not null").groupBy("variable", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("variable").agg(F.max("n").alias("top"), F.sum("n").alias("n"), F.count("*").alias("n_values")).withColumn("share", F.col("top") / F.col("n"))


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct linear-interpolation quantile edges of a column; at most bins + 1 numbers."""
    return sorted({r.q for r in quantiles(df, column, [i / bins for i in range(bins + 1)]).collect()})


def bucket(c: Column, edges: Sequence[float]) -> Column:
    """Number of the bin (lo, hi] that holds a value, the lowest edge included; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = c >= edges[i] if i == 0 else c > edges[i]
        out = F.when(low & (c <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def row_at_extreme(df: DataFrame, by: Sequence[str], order: Column, tie: str) -> DataFrame:
    """The whole row of the largest ``order`` of each group, the smallest ``tie`` of equal ones."""
    w = Window.partitionBy(*by).orderBy(order.desc_nulls_last(), F.col(tie))
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
