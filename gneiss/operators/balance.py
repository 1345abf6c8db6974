"""Class balancing of a training table: oversampling by interpolation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.columns import uniform
from gneiss.operators.joins import nearest
from gneiss.operators.order import positions


def _interpolate(seeds: DataFrame, neighbours: DataFrame, vectors: DataFrame, seed: int) -> DataFrame:
    """New vectors between seed rows (``id``, ``copy``) and one of their neighbours."""
    pick = seeds.join(neighbours.select(F.col("query").alias("id"), "point", "nth"), "id")
    most = F.max("nth").over(Window.partitionBy("id", "copy"))
    pick = pick.withColumn("most", most).where(F.col("nth") == F.floor(uniform("id", "copy", seed=seed) * F.col("most")) + 1)
    a = vectors.select("id", F.col("embedding").alias("x"))
    b = vectors.select(F.col("id").alias("point"), F.col("embedding").alias("y"))
    gap = uniform("id", "copy", seed=seed + 1)
    both = pick.join(a, "id").join(b, "point").withColumn("gap", gap)
    return both.select("id", "copy", "point", F.zip_with("x", "y", lambda p, q: p + (q - p) * F.col("gap")).alias("embedding"))


def smote(minority: DataFrame, majority_rows: int, ratio: float = 0.5, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows up to ratio * majority_rows, each between a row and one of its k nearest.

    ``minority`` has ``id`` and ``embedding``. Seeds are taken in turn in
    order of a hash, so every row serves before one serves again; all draws
    are hashes of the row, so a repeated task gives the same rows. With fewer
    than two minority rows, or enough already, the result is empty.
    """
    vectors = minority.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = vectors.count()
    wanted = max(0, math.floor(ratio * majority_rows) - n) if n > 1 else 0
    rank = positions(vectors.select("id"), uniform("id", seed=seed), F.col("id"), name="nth")
    turns = F.sequence(F.lit(0), F.lit(max(0, -(-wanted // max(n, 1)) - 1)))
    seeds = rank.withColumn("copy", F.explode(turns)).where(F.col("copy") * n + F.col("nth") < wanted).select("id", "copy")
    return _interpolate(seeds, nearest(vectors, vectors, min(k, max(n - 1, 1))), vectors, seed)


def adasyn(rows: DataFrame, ratio: float = 0.5, k: int = 5, seed: int = 42) -> DataFrame:
    """Like :func:`smote`, but rows with more majority neighbours serve more often.

    ``rows`` has ``id``, ``embedding`` and ``y`` (1: minority).
    """
    vectors = rows.select("id", "y", F.col("embedding").cast("array<double>").alias("embedding"))
    minority = vectors.where("y = 1")
    n, m = minority.count(), vectors.where("y = 0").count()
    wanted = max(0, math.floor(ratio * m) - n) if n > 1 else 0
    around = nearest(minority.select("id", "embedding"), vectors.select("id", "embedding"), k).join(vectors.select(F.col("id").alias("point"), "y"), "point")
    share = around.groupBy(F.col("query").alias("id")).agg(F.avg(1 - F.col("y")).alias("share"))
    whole = share.agg(F.sum("share").alias("whole"))
    counted = share.crossJoin(whole).withColumn("times", F.round(F.try_divide(F.col("share"), F.col("whole")) * wanted).cast("int")).where("times > 0")
    seeds = counted.select("id", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    own = minority.select("id", "embedding")
    return _interpolate(seeds, nearest(own, own, min(k, max(n - 1, 1))), own, seed)
