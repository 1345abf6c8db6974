"""Joins that keep row counts, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feature_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of one-row-per-key features; a repeated key on the right is an error at run time."""
    checked = right.withColumn("copies_of_key", F.count("*").over(Window.partitionBy(key)))
    checked = checked.where(F.col("copies_of_key") == F.when(F.col("copies_of_key") == 1, 1).otherwise(F.raise_error(F.lit(f"repeated {key}")).cast("int")))
    return left.join(checked.drop("copies_of_key"), key, "left")


def integrity(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Rows before and after a left join, and whether the right key is unique."""
    before = left.agg(F.count("*").alias("rows_before"))
    after = left.select(key).join(right.select(key), key, "left").agg(F.count("*").alias("rows_after"))
    return before.crossJoin(after).select(F.lit(name).alias("source"), "rows_before", "rows_after", (F.col("rows_before") == F.col("rows_after")).alias("kept"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct child keys, and those that the parent lacks."""
    keys = child.select(key).where(F.col(key).isNotNull()).distinct()
    lost = keys.join(parent.select(key), key, "left_anti").agg(F.count("*").alias("orphans"))
    return keys.agg(F.count("*").alias("keys")).crossJoin(lost)


#: Distances by products that one step of a task holds; numbers of the differences that it takes at a time.
ROUGH, EXACT = 1_000_000, 2_000_000


def closest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of ``y`` for each row of ``x``: places in both and distances; ties by place in ``y``.

    Distances are of differences. Those by products only leave out rows that
    are farther than the k-th by more than their rounding error; with values
    that aren't finite, or whose squares aren't, none are left out.
    """
    with np.errstate(all="ignore"):
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        whole = k >= len(y) or not np.isfinite(xx.max(initial=0) + yy.max(initial=0)) or np.isnan(xx).any() or np.isnan(yy).any()
        slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + yy.max(initial=0)) + 1e-290
        parts, step, some = [], max(1, ROUGH // max(len(y), 1)), max(1, EXACT // max(x.shape[1], 1))
        for at in range(0, len(x), step):
            own = x[at : at + step]
            if whole:
                q, p = np.divmod(np.arange(len(own) * len(y)), len(y))
            else:
                rough = xx[at : at + step, None] - 2 * own @ y.T + yy
                limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack[at : at + step]
                q, p = np.nonzero(rough <= limit[:, None])
            d = np.empty(len(q))
            for i in range(0, len(q), some):
                gap = own[q[i : i + some]] - y[p[i : i + some]]
                d[i : i + some] = np.sqrt((gap * gap).sum(-1))
            order = np.lexsort((p, d, q))
            n = np.bincount(q, minlength=len(own))
            order = order[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) < k]
            parts.append((q[order] + at, p[order], d[order]))
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True))


def nearest(queries: DataFrame, points: DataFrame, k: int, vector: str = "embedding", block: int = 4096) -> DataFrame:
    """Exact k nearest points (Euclidean) of each query; ties by smaller id.

    ``queries`` and ``points`` have ``id`` and the vector. Points are cut into
    blocks and every block meets every block of queries, so no table is
    broadcast or gathered; each pair of blocks keeps k a query before the
    final ranking. Null vectors and vectors of another length are left out.
    """

    def packed(df: DataFrame, name: str, other: str, own: int, others: int) -> DataFrame:
        rows = df.where(F.col(vector).isNotNull()).select(F.col("id").alias(name), F.col(vector).cast("array<double>").alias(f"{name}_vector"))
        rows = rows.withColumn(f"{name}_block", F.pmod(F.xxhash64(name), F.lit(own)))
        return rows.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    n, m = (max(1, -(-df.count() // block)) for df in (queries, points))
    left, right = packed(queries, "query", "point", n, m), packed(points, "point", "query", m, n)
    both = left.groupBy("query_block", "point_block").cogroup(right.groupBy("query_block", "point_block"))

    def top(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "point": [], "distance": []})
        x, y = np.stack(a["query_vector"]), np.stack(b["point_vector"])
        ids = b["point"].to_numpy()
        order = np.argsort(ids, kind="stable")
        at, near, d = closest(x, y[order], k + 1)
        return pd.DataFrame({"query": a["query"].to_numpy()[at], "point": ids[order][near], "distance": d})

    found = both.applyInPandas(top, "query long, point long, distance double").where("query <> point")
    w = Window.partitionBy("query").orderBy("distance", "point")
    return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def nearest_cells(queries: DataFrame, points: DataFrame, k: int, centres: np.ndarray, probes: int, vector: str = "embedding") -> DataFrame:
    """Approximate k nearest points: only those in the ``probes`` cells nearest to a query.

    ``centres`` are a bounded set of cell centres, fitted beforehand.
    """

    def cells(n: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                if len(df):
                    x = np.stack(df["vector"])
                    near = np.argsort(((x[:, None, :] - centres[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :n]
                    yield pd.DataFrame({"id": np.repeat(df["id"].to_numpy(), n), "cell": near.ravel(), "vector": list(np.repeat(x, n, axis=0))})

        return run

    def placed(df: DataFrame, n: int) -> DataFrame:
        rows = df.where(F.col(vector).isNotNull()).select("id", F.col(vector).cast("array<double>").alias("vector"))
        return rows.mapInPandas(cells(n), "id long, cell int, vector array<double>")

    left = placed(queries, probes).select("cell", F.col("id").alias("query"), F.col("vector").alias("x"))
    right = placed(points, 1).select("cell", F.col("id").alias("point"), F.col("vector").alias("y"))
    distance = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    found = left.join(right, "cell").where("query <> point").select("query", "point", distance.alias("distance"))
    w = Window.partitionBy("query").orderBy("distance", "point")
    return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
