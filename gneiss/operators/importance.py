"""Which search parameters matter: variance shares of a forest over run histories, and densities of good against other runs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import regression as reg
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.contributions import MAX_NODES, node_table
from gneiss.operators.quantiles import wide


def forest_of_runs(runs: DataFrame, columns: Sequence[str], score: str, trees: int = 20, depth: int = 8, seed: int = 42) -> PipelineModel:
    """A regression forest of the score of a run on its parameters (numeric, without nulls)."""
    forest = reg.RandomForestRegressor(featuresCol="features", labelCol=score, numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="all")
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), forest]).fit(runs)


def _boxes(nodes: Sequence, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, lower and upper corner of every leaf of a tree, in shares of the ranges."""
    by = {n.node: n for n in nodes}
    out, stack = [], [(by[0], np.zeros(len(low)), np.ones(len(low)))]
    while stack:
        n, a, b = stack.pop()
        if n.left < 0:
            out.append((n.value, a, b))
            continue
        if n.categories >= 0:
            raise ValueError("parameters must be numbers")
        j = n.feature
        cut = min(max((n["values"][0] - low[j]) / (high[j] - low[j]), a[j]), b[j])
        left, right = b.copy(), a.copy()
        left[j], right[j] = cut, cut
        stack += [(by[n.left], a, left), (by[n.right], right, b)]
    return np.array([v for v, _, _ in out]), np.array([a for _, a, _ in out]), np.array([b for _, _, b in out])


def _marginal(value: np.ndarray, a: np.ndarray, b: np.ndarray, own: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean over all other parameters on the cells that the cuts of ``own`` make, and the cells' sizes."""
    cuts = [np.unique(np.concatenate([a[:, j], b[:, j]])) for j in own]
    rest = np.prod(np.delete(b - a, own, axis=1), axis=1)
    inside = [(a[:, j, None] <= c[None, :-1]) & (b[:, j, None] >= c[None, 1:]) for j, c in zip(own, cuts, strict=True)]
    size = np.diff(cuts[0])
    if len(own) == 1:
        return (value * rest) @ inside[0], size
    return np.einsum("l,lx,ly->xy", value * rest, *inside), size[:, None] * np.diff(cuts[1])[None]


def variance_shares(model: PipelineModel, ranges: dict[str, tuple[float, float]]) -> dict[tuple[str, ...], float]:
    """Share of a forest's variance over uniform parameters that each parameter, and each pair beyond its two, accounts for.

    ``ranges`` are the columns of the model in order with their limits. A
    tree's marginals are exact from its leaves' boxes; shares are means over
    trees, those of constant trees 0. The forest is bounded by its parameters.
    """
    nodes = node_table(model).limit(MAX_NODES + 1).collect()
    if len(nodes) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    names = list(ranges)
    low, high = (np.array([ranges[c][i] for c in names], float) for i in (0, 1))
    trees: dict[int, list] = {}
    for n in nodes:
        trees.setdefault(n.tree, []).append(n)
    shares = {own: 0.0 for k in (1, 2) for own in combinations(names, k)}
    for own_nodes in trees.values():
        value, a, b = _boxes(own_nodes, low, high)
        size = np.prod(b - a, axis=1)
        value = value - value @ size
        total = (value * value) @ size
        if total <= 0:
            continue
        single = {}
        for j, c in enumerate(names):
            mean, width = _marginal(value, a, b, [j])
            single[c] = float((mean * mean * width).sum())
            shares[c,] += single[c] / total / len(trees)
        for (i, c), (j, e) in combinations(list(enumerate(names)), 2):
            mean, width = _marginal(value, a, b, [i, j])
            shares[c, e] += (float((mean * mean * width).sum()) - single[c] - single[e]) / total / len(trees)
    return shares


def density_ratio(runs: DataFrame, parameter: str, score: str, grid: Sequence[float], good: float = 0.25) -> DataFrame:
    """Kernel densities of a parameter among the best runs (score at or over its quantile 1 - ``good``) and the others, and their ratio, on a grid.

    Normal kernels of width sd * n^(-1/5) of each group (1 without spread).
    Every run counts; the sums are one group for each point of the grid.
    """
    known = runs.where(F.col(parameter).isNotNull() & F.col(score).isNotNull()).select(F.col(parameter).cast("double").alias("x"), F.col(score).cast("double").alias("score"))
    rows = known.crossJoin(F.broadcast(wide(known, "score", {"limit": 1 - good})))  # one row
    rows = rows.withColumn("good", F.col("score") >= F.col("limit"))
    widths = rows.groupBy("good").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sd")).withColumn("width", F.when(F.col("sd") > 0, F.col("sd") * F.pow("n", F.lit(-0.2))).otherwise(1.0))
    spread = rows.join(F.broadcast(widths), "good").withColumn("at", F.explode(F.array(*(F.lit(float(g)) for g in grid))))  # two rows
    z = (F.col("at") - F.col("x")) / F.col("width")
    kernel = F.exp(-z * z / 2) / (F.col("width") * F.lit(float(np.sqrt(2 * np.pi))) * F.col("n"))
    each = spread.groupBy("at").agg(*(F.sum(F.when(F.col("good") == flag, kernel).otherwise(0.0)).alias(name) for flag, name in ((True, "density_good"), (False, "density_rest"))))
    return each.withColumn("ratio", F.try_divide("density_good", "density_rest"))
