"""An index of vectors whose cells grow with the table.

Cells are a tree of two levels, each with the fourth root of the rows: Spark's
k-means gives the coarse centres, and each coarse cell is cut by k-means over a
bounded hash sample of its rows. So there are as many cells as the root of the
rows, a cell has about as many rows, and neither the coarse centres nor the
fine ones of a coarse cell ever are more than the fourth root. All rows are
placed and kept as a table by cell; a search reads the cells nearest to a
query, as many as a measured recall asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.joins import closest, nearest
from gneiss.sources.storage import materialize

#: Rows for each fine centre in the sample of a coarse cell; rows of a coarse cell that one task places.
SAMPLE, PLACED = 128, 50_000
#: Rows of a coarse cell and queries that meet in one group of a search.
SEARCHED, ASKED = 8192, 4096


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds from rows far from each other; no more than distinct rows."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    rng = np.random.Generator(np.random.PCG64(42))
    picked = [int(rng.integers(len(x)))]
    away = ((x - x[picked[0]]) ** 2).sum(1)
    for _ in range(1, k):
        picked.append(int(rng.choice(len(x), p=away / away.sum())))
        away = np.minimum(away, ((x - x[picked[-1]]) ** 2).sum(1))
    centres = x[picked]
    for _ in range(rounds):
        own = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        centres = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
    return centres


class VectorIndex:
    """Fitted on the rows it indexes: ``id`` (long, unique) and a vector; null vectors are left out, all have one length."""

    def __init__(self, points: DataFrame, vector: str = "embedding"):
        rows = points.where(F.col(vector).isNotNull()).select("id", F.col(vector).cast("array<double>").alias("x"))
        self.rows = rows.count()
        self.root = max(1, math.ceil(self.rows ** 0.25))
        self.coarse, own = self._coarse(rows)
        self.fine = materialize(self._fine(own), "fine_centres")
        self.table = self._placed(own)

    def _coarse(self, rows: DataFrame) -> tuple[np.ndarray, DataFrame]:
        if not self.rows:
            return np.zeros((0, 0)), materialize(rows.withColumn("coarse", F.lit(0)), "coarse")
        model = KMeans(k=max(2, self.root), seed=42, featuresCol="__v", predictionCol="coarse").fit(rows.select(array_to_vector("x").alias("__v")))
        placed = model.transform(rows.withColumn("__v", array_to_vector("x"))).drop("__v")
        return np.array(model.clusterCenters()), materialize(placed, "coarse")

    def _fine(self, own: DataFrame) -> DataFrame:
        """``coarse``, ``cell`` (a number of its own) and ``centre``."""
        root, wanted = self.root, SAMPLE * self.root
        sizes = own.groupBy("coarse").agg(F.count("*").alias("n"))
        share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = own.join(sizes, "coarse").where((F.col("n") <= wanted) | (share < F.lit(float(wanted)) / F.col("n"))).select("coarse", "x")

        def cut(rows: pd.DataFrame) -> pd.DataFrame:
            coarse = int(rows["coarse"].iloc[0])
            # rows in a fixed order, so a repeated task gives the same centres
            centres = _cluster(np.stack(rows["x"]), root)
            return pd.DataFrame({"coarse": coarse, "cell": coarse * np.int64(1 << 32) + np.arange(len(centres)), "centre": list(centres)})

        return sample.groupBy("coarse").applyInPandas(cut, "coarse int, cell long, centre array<double>")

    def _placed(self, own: DataFrame) -> DataFrame:
        """Every row with its cell; a large coarse cell is dealt over several tasks."""
        sizes = own.groupBy("coarse").agg(F.ceil(F.count("*") / PLACED).alias("tasks"))
        rows = own.join(sizes, "coarse").withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks")))
        parts = sizes.select(F.col("coarse").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("part"))
        centres = self.fine.join(parts, F.col("coarse") == F.col("of")).select("of", "part", "cell", "centre")

        def place(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a):
                return pd.DataFrame({"id": [], "x": [], "cell": []})
            x, c = np.stack(a["x"]), np.stack(b["centre"])
            at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            return pd.DataFrame({"id": a["id"], "x": a["x"], "cell": b["cell"].to_numpy()[at]})

        both = rows.groupBy("coarse", "task").cogroup(centres.groupBy("of", "part"))
        return materialize(both.applyInPandas(place, "id long, x array<double>, cell long").repartition("cell").sortWithinPartitions("cell"), "cells")

    def cells(self, queries: DataFrame, probes: int, vector: str = "embedding") -> DataFrame:
        """``query`` and the ``probes`` nearest cells with their ``place`` from 0: the nearest fine ones of as many coarse cells."""
        coarse, most = self.coarse, min(probes, len(self.coarse))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                if len(df) and most:
                    x = np.stack(df["q"])
                    found = np.argsort((coarse * coarse).sum(1) - 2 * x @ coarse.T, axis=1, kind="stable")[:, :most]
                    yield pd.DataFrame({"query": np.repeat(df["query"].to_numpy(), most), "q": list(np.repeat(x, most, axis=0)), "coarse": found.ravel()})

        asked = queries.where(F.col(vector).isNotNull()).select(F.col("id").alias("query"), F.col(vector).cast("array<double>").alias("q"))
        asked = asked.mapInPandas(near, "query long, q array<double>, coarse int").join(self.fine, "coarse")
        away = F.aggregate(F.zip_with("q", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        place = F.row_number().over(Window.partitionBy("query").orderBy("away", "cell")) - 1
        # vectors stay behind before the shuffle
        return asked.select("query", "cell", away.alias("away")).withColumn("place", place).where(F.col("place") < probes).select("query", "cell", "place")

    def search(self, queries: DataFrame, k: int, probes: int, vector: str = "embedding") -> DataFrame:
        """``query``, ``point``, ``distance`` and ``nth``: the k nearest other rows within the cells of each query; ties by smaller id."""
        # cells of a query go together to the parts of their coarse cell, whose rows are dealt evenly
        coarse = F.shiftright("cell", 32)
        asked = queries.where(F.col(vector).isNotNull()).select(F.col("id").alias("query"), F.col(vector).cast("array<double>").alias("q"))
        blocks = max(1, -(-asked.count() // ASKED))
        chosen = self.cells(queries, probes, vector).groupBy("query", coarse.alias("coarse")).agg(F.collect_list("cell").alias("cells"))
        tasks = self.table.groupBy(coarse.alias("coarse")).agg(F.ceil(F.count("*") / SEARCHED).alias("tasks"))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        left = chosen.join(tasks, "coarse").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("part", upto(F.col("tasks"))).join(asked, "query").select("coarse", "part", "block", "query", "q", "cells")
        right = self.table.withColumn("coarse", coarse).join(tasks, "coarse").withColumn("part", F.pmod(F.xxhash64("id"), F.col("tasks"))).withColumn("block", upto(F.lit(blocks).cast("long"))).select("coarse", "part", "block", "id", "x", "cell")

        def top(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query": [], "point": [], "distance": []})
            b = b.sort_values("id", kind="stable")
            x, y, ids = np.stack(a["q"]), np.stack(b["x"]), b["id"].to_numpy()
            own, of = b["cell"].to_numpy(), np.repeat(np.arange(len(a)), a["cells"].map(len))
            wanted = np.concatenate(list(a["cells"]))
            parts = []
            for cell in np.unique(own):
                asking, here = of[wanted == cell], np.flatnonzero(own == cell)
                if len(asking):
                    at, near, d = closest(x[asking], y[here], k + 1)
                    parts.append((asking[at], here[near], d))
            if not parts:
                return pd.DataFrame({"query": [], "point": [], "distance": []})
            at, near, d = (np.concatenate(v) for v in zip(*parts, strict=True))
            order = np.lexsort((near, d, at))
            n = np.bincount(at, minlength=len(a))
            order = order[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) <= k]
            return pd.DataFrame({"query": a["query"].to_numpy()[at[order]], "point": ids[near[order]], "distance": d[order]})

        keys = ["coarse", "part", "block"]
        found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(top, "query long, point long, distance double").where("query <> point")
        return found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("distance", "point"))).where(F.col("nth") <= k)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.9, vector: str = "embedding") -> DataFrame:
        """For numbers of probes in doubling steps: ``recall`` of the exact k nearest rows, and ``read``, the share of rows in the cells of a query.

        The exact neighbours of ``queries`` (a bounded sample) are looked up
        once; each counts for every number of probes that reaches its cell.
        """
        queries = materialize(queries.select("id", vector), "sample")  # it is asked for at every step
        exact = nearest(queries, self.table.select("id", F.col("x").alias(vector)), k, vector).select("query", "point")
        own = materialize(exact.join(self.table.select(F.col("id").alias("point"), "cell"), "point").select("query", "cell"), "exact")
        sizes = self.table.groupBy("cell").agg(F.count("*").alias("n"))
        everything, wanted = self.fine.count(), own.count()
        steps = sorted({min(2**i, everything) for i in range(everything.bit_length() + 1)})
        # each number of probes looks into its own coarse cells
        cells = materialize(reduce(DataFrame.unionByName, (self.cells(queries, p, vector).select("query", "cell", F.lit(p).alias("probes")) for p in steps)), "probed")
        asked = queries.where(F.col(vector).isNotNull()).count()
        hits = cells.join(own, ["query", "cell"]).groupBy("probes").agg((F.count("*") / max(wanted, 1)).alias("recall"))
        read = cells.join(sizes, "cell").groupBy("probes").agg((F.sum("n") / max(asked * self.rows, 1)).alias("read"))
        return read.join(hits, "probes", "left").select("probes", F.coalesce("recall", F.lit(0.0)).alias("recall"), "read", F.coalesce(F.col("recall") >= recall, F.lit(False)).alias("enough"))
