"""Exact quantiles without a group that holds a column.

A sketch of fixed size brackets every quantile between two values. One pass
counts rows by bracket, values inside a bracket each by itself, and running
counts over those values, dealt by range, find the two rows to interpolate
between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.order import running
from gneiss.sources.storage import materialize

#: Rows of a bracket are about four times one part in so many of a group.
ACCURACY = 1_000


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """``by``, ``p`` and ``q``: quantiles of a column with linear interpolation between rows, like ``percentile``.

    Missing values are left out; a group without values has no rows, and
    neither has an empty table. ``by`` must not be null.
    """
    probs, by = sorted(set(map(float, probs))), list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    found = materialize(_selected(rows, probs, by, 2 / accuracy, accuracy), "quantiles")
    # the sketch may err; then brackets are whole ranges
    if found.where("q is null").first() is not None:
        found = _selected(rows, probs, by, 1.0, accuracy)
    return found


def wide(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The same with a column for each named quantile, a row for each group."""
    found = quantiles(df, value, list(named.values()), by)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("p") == p, F.col("q"))).alias(name) for name, p in named.items()))


def _selected(rows: DataFrame, probs: list[float], by: list[str], margin: float, accuracy: int) -> DataFrame:
    # one sketch for all edges, so they are in order
    marks = sorted({m for p in probs for m in (p - margin, p + margin) if 0 < m < 1})
    known = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), *([F.percentile_approx("__v", marks, accuracy).alias("edges")] if marks else []))

    def edge(m: float):
        return F.col("least") if m <= 0 else F.col("most") if m >= 1 else F.get("edges", F.lit(marks.index(m)))

    ends = [F.array(*(edge(p + s * margin) for p in probs)).alias(end) for end, s in (("low", -1), ("high", 1))]
    sketch = materialize(known.where("n > 0").select(*by, "n", *ends), "brackets")
    if by:
        placed = rows.join(sketch, by)
    else:
        r = sketch.first()
        lows, highs = (r.low, r.high) if r else ([], [])
        literal = lambda x: F.array(*map(F.lit, x)).cast("array<double>")
        placed = rows.withColumns({"low": literal(lows), "high": literal(highs)})
    # brackets are in order of p, so a value is under as many lows as there are in front of its place
    place = F.size(F.filter("low", lambda x: x <= F.col("__v")))
    inside = F.exists(F.arrays_zip("low", "high"), lambda b: (b["low"] <= F.col("__v")) & (F.col("__v") <= b["high"]))
    cells = placed.groupBy(*by, place.alias("place"), F.when(inside, F.col("__v")).alias("v")).agg(F.count("*").alias("rows"))
    cells = materialize(cells, "cells")
    wanted = sketch.select(*by, "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b")).select(*by, "i", "b.low", "b.high", (F.element_at(F.array(*map(F.lit, probs)), F.col("i") + 1) * (F.col("n") - 1)).alias("at"))
    both = cells.join(wanted, by) if by else cells.crossJoin(F.broadcast(wanted))  # a row for each of probs
    under = both.where(F.col("place") <= F.col("i")).groupBy(*by, "i").agg(F.sum("rows").alias("under"))
    near = both.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))).select(*by, "i", "v", "rows")
    summed = running(near, [F.asc("v")], {"upto": F.col("rows")}, [*by, "i"]).drop("low", "high")
    keys = [*by, "i"]
    t = summed.join(wanted.select(*keys, "at"), keys).join(under, keys, "left").withColumn("upto", F.col("upto") + F.coalesce("under", F.lit(0)))
    first, part = F.floor("at"), F.col("at") - F.floor("at")
    t = t.groupBy(*keys).agg(
        F.min(F.when(F.col("upto") > first, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > first + 1, F.col("v"))).alias("b"),
        F.max(part).alias("part"), F.max(first).alias("first"), F.max(F.coalesce("under", F.lit(0))).alias("under"),
    )
    q = F.when(F.col("under") <= F.col("first"), F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + F.col("part") * (F.col("b") - F.col("a"))))
    return t.select(*by, F.element_at(F.array(*map(F.lit, probs)), F.col("i") + 1).alias("p"), q.alias("q"))
