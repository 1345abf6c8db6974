"""Contributions of columns to a model's score: exact for trees, by weighted coalitions for any model.

A tree model is exported as a table of nodes, bounded by its parameters (trees,
depth), and goes to the tasks as part of the function; rows are scored in
batches where they are. For other models coalitions and background rows are an
axis of rows: the model scores them as it scores any table, and the regression
over coalitions is one weighted sum for each column, as its normal equations
don't depend on the case.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from gneiss.sources.storage import materialize, shared_dir

#: Nodes of a model at most (a forest of 1,000 trees of depth 10 has fewer).
MAX_NODES = 2_000_000
#: Columns up to which every coalition is evaluated.
ALL_COALITIONS = 10

_NODE = "nodeData.id as node, nodeData.prediction, nodeData.impurityStats as stats, nodeData.rawCount as cover, nodeData.leftChild as left, nodeData.rightChild as right, nodeData.split.*"


def node_table(model: PipelineModel) -> DataFrame:
    """Nodes of the last stage of a pipeline, a tree, forest or boosting model of Spark ML.

    ``tree``, its ``weight`` in the margin, ``node``, ``left`` and ``right``
    (-1: leaf), ``feature``, ``values`` (a threshold, or the categories that go
    left), ``categories`` (-1: a threshold), ``cover`` (training rows) and
    ``value``: what the node would predict. The margin of a row is the weighted
    sum of its leaves' values: the probability of class 1 of a tree, the mean
    of the trees' for a forest, the sum that boosting takes the sign of, or the
    prediction of a regression.
    """
    last = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    last.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "weight").select("tree", "weight")
        nodes = saved.withColumnRenamed("treeID", "tree").join(weights, "tree").selectExpr("tree", "weight", *_NODE.split(", "))
    else:
        nodes = saved.selectExpr("0 as tree", "1.0D as weight", *_NODE.replace("nodeData.", "").split(", "))
    kind = type(last).__name__
    if kind in ("DecisionTreeClassificationModel", "RandomForestClassificationModel"):
        value = F.get("stats", F.lit(1)) / F.aggregate("stats", F.lit(0.0), lambda s, x: s + x)
    else:
        value = F.col("prediction")
    share = F.lit(1.0 / last.getNumTrees) if kind.startswith("RandomForest") else F.lit(1.0)
    return nodes.select("tree", (F.col("weight") * share).alias("weight"), "node", "left", "right", F.col("featureIndex").alias("feature"), F.col("leftCategoriesOrThreshold").alias("values"), F.col("numCategories").alias("categories"), "cover", value.alias("value"))


class _Leaf:
    """A leaf with its path: for each column on it the share of training rows that follow it, and the splits that a row must pass."""

    def __init__(self, value: float, share: float, path: dict[int, tuple[float, list]]):
        self.value, self.share, self.columns = value, share, sorted(path)
        self.shares = np.array([path[c][0] for c in self.columns])
        self.splits = [path[c][1] for c in self.columns]


def leaves(nodes: Sequence) -> tuple[float, list[_Leaf]]:
    """Expected margin over the training rows, and the leaves of all trees (rows of :func:`node_table`)."""
    by = {(n.tree, n.node): n for n in nodes}
    out: list[_Leaf] = []
    for root in (n for n in nodes if n.node == 0):
        stack = [(root, 1.0, {})]
        while stack:
            n, share, path = stack.pop()
            if n.left < 0:
                out.append(_Leaf(n.weight * n.value, share, path))
                continue
            for child, left in ((by[n.tree, n.left], True), (by[n.tree, n.right], False)):
                part = child.cover / n.cover if n.cover else 0.0
                split = (left, np.array(n.values)) if n.categories >= 0 else (left, float(n.values[0]))
                old, splits = path.get(n.feature, (1.0, []))
                stack.append((child, share * part, path | {n.feature: (old * part, [*splits, split])}))
    return float(sum(leaf.share * leaf.value for leaf in out)), out


def _passes(x: np.ndarray, splits: list) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for left, by in splits:
        ok &= (np.isin(x, by) if isinstance(by, np.ndarray) else x <= by) == left
    return ok


def path_contributions(x: np.ndarray, found: list[_Leaf]) -> np.ndarray:
    """Shapley values of every row of ``x`` where a column outside a coalition follows the training rows' shares.

    A leaf's game is a product over the columns of its path: a column in the
    coalition gives whether the row passes, one outside the share. The average
    over orders is the integral over t in (0, 1) of the other columns' factors
    share (1 - t) + passes t, a polynomial, so a quadrature of as many nodes as
    half its degree is exact.
    """
    out = np.zeros(x.shape)
    for leaf in found:
        m = len(leaf.columns)
        if not m:
            continue
        passes = np.column_stack([_passes(x[:, c], s) for c, s in zip(leaf.columns, leaf.splits, strict=True)])
        own = passes - leaf.shares
        for t, w in zip(*np.polynomial.legendre.leggauss((m + 1) // 2), strict=True):
            t, w = (t + 1) / 2, w / 2
            factor = leaf.shares * (1 - t) + passes * t
            before = np.cumprod(np.column_stack([np.ones(len(x)), factor[:, :-1]]), axis=1)
            after = np.cumprod(np.column_stack([np.ones(len(x)), factor[:, :0:-1]]), axis=1)[:, ::-1]
            out[:, leaf.columns] += leaf.value * w * before * after * own
    return out


def margins(x: np.ndarray, found: list[_Leaf]) -> np.ndarray:
    """Weighted sum of the leaves that each row reaches."""
    out = np.zeros(len(x))
    for leaf in found:
        ok = np.ones(len(x), bool)
        for c, s in zip(leaf.columns, leaf.splits, strict=True):
            ok &= _passes(x[:, c], s)
        out += leaf.value * ok
    return out


def tree_contributions(model: PipelineModel, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``margin``, ``base`` and ``effects`` (an array in the order of ``columns``): base plus effects is the margin.

    Columns must be numeric and without nulls, as the model's own. Columns
    named like the new ones are replaced.
    """
    nodes = node_table(model).limit(MAX_NODES + 1).collect()
    if len(nodes) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes")
    base, found = leaves(nodes)
    kept = rows.drop("margin", "base", "effects")
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names]) if len(batch) else np.zeros((0, len(names)))
            effects = path_contributions(x, found)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(effects.ravel()))
            new = {"margin": pa.array(margins(x, found)), "base": pa.array(np.full(len(x), base)), "effects": flat}
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])

    double = Ty.DoubleType()
    schema = Ty.StructType([*kept.schema.fields, Ty.StructField("margin", double), Ty.StructField("base", double), Ty.StructField("effects", Ty.ArrayType(double))])
    return kept.mapInArrow(run, schema)


def long_form(explained: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key``, ``feature`` and ``effect``, a row for each column of each explained row."""
    named = F.arrays_zip(F.array(*map(F.lit, columns)).alias("feature"), F.col("effects").alias("effect"))
    return explained.select(key, F.explode(named).alias("x")).select(key, "x.feature", "x.effect")


def background(rows: DataFrame, columns: Sequence[str], number: int = 25, seed: int = 42) -> DataFrame:
    """At most ``number`` k-means centres of ``columns``, with ``weight``, the share of rows that are nearest to each.

    Columns must be numeric and without nulls. A table of fewer distinct rows
    gives fewer centres.
    """
    spread = rows.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    scale = {c: float(spread[c] or 1.0) for c in columns}
    scaled = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__v").transform(rows.select(*((F.col(c) / scale[c]).alias(f"__{c}") for c in columns)))
    model = KMeans(k=number, seed=seed, featuresCol="__v", predictionCol="__at").fit(scaled)
    centres = [(i, *(float(v) * scale[c] for v, c in zip(centre, columns, strict=True))) for i, centre in enumerate(model.clusterCenters())]
    schema = ", ".join(["__at int", *(f"`{c}` double" for c in columns)])
    sizes = model.transform(scaled).groupBy("__at").agg(F.count("*").alias("n"))
    total = F.sum("n")
    known = rows.sparkSession.createDataFrame(centres, schema).join(sizes, "__at")
    return known.crossJoin(sizes.agg(total.alias("__all"))).select(*columns, (F.col("n") / F.col("__all")).alias("weight"))


def coalitions(d: int, number: int | None = None, seed: int = 42) -> list[tuple[tuple[int, ...], float]]:
    """Coalitions of ``d`` columns (in or out) with their kernel weights.

    All of them up to ALL_COALITIONS columns, or ``number`` drawn with their
    complements, sizes by their share of the kernel.
    """
    kernel = {s: (d - 1) / (s * (d - s)) for s in range(1, d)}
    if d <= ALL_COALITIONS and number is None:
        return [(z, kernel[sum(z)] / comb(d, sum(z))) for i in range(1, 2**d - 1) for z in [tuple(i >> j & 1 for j in range(d))]]
    rng = np.random.Generator(np.random.PCG64(seed))
    chance = np.array(list(kernel.values())) / sum(kernel.values())
    counts: dict[tuple[int, ...], float] = {}
    for _ in range((number or 2 * d + 2048) // 2):
        z = np.zeros(d, int)
        z[rng.permutation(d)[: 1 + rng.choice(d - 1, p=chance)]] = 1
        for own in (tuple(z.tolist()), tuple((1 - z).tolist())):
            counts[own] = counts.get(own, 0.0) + 1.0
    return list(counts.items())


def model_contributions(cases: DataFrame, key: str, columns: Sequence[str], around: DataFrame, predict: Callable[[DataFrame], DataFrame], number: int | None = None, seed: int = 42) -> DataFrame:
    """Contributions of ``columns`` to the score of any model, against the rows of ``around`` (columns and ``weight``).

    ``predict`` adds ``s`` to a table with ``id`` (long) and ``columns``. For
    each coalition the columns outside it take the values of each row of
    ``around``; scores are averaged by weight. Effects solve the kernel
    regression under the constraint that with ``base`` they sum to the score of
    the case: exact if all coalitions are evaluated. Returns ``key``,
    ``feature``, ``effect``, ``base`` and ``score``. ``key`` must be unique.
    Work is cases x coalitions x rows of ``around``.
    """
    d = len(columns)
    if d == 1:
        sets, inverse = [], np.zeros((0, 0))
    else:
        sets = coalitions(d, number, seed)
        z, w = np.array([s for s, _ in sets], float), np.array([v for _, v in sets])
        free = z[:, :-1] - z[:, -1:]
        inverse = np.linalg.pinv(free.T @ (free * w[:, None]))
    spark = cases.sparkSession
    # the empty coalition gives the base, the full one the score of the case
    axis = [(0, [0] * d, 0.0), (1, [1] * d, 0.0), *((i + 2, list(s), float(v)) for i, (s, v) in enumerate(sets))]
    axis = spark.createDataFrame(axis, "coalition int, members array<int>, kernel double")
    outside = around.select(*(F.col(c).alias(f"__out_{c}") for c in columns), F.col("weight").alias("__weight"))
    spread = cases.select(F.col(key).alias("__key"), *columns).crossJoin(F.broadcast(axis)).crossJoin(F.broadcast(outside))  # a bounded list of coalitions and of centres
    mixed = spread.where("coalition <> 1").unionByName(cases.select(F.col(key).alias("__key"), *columns).crossJoin(F.broadcast(axis.where("coalition = 1"))).withColumns({f"__out_{c}": F.col(c) for c in columns} | {"__weight": F.lit(1.0)}))
    mixed = mixed.withColumns({c: F.when(F.get("members", F.lit(j)) == 1, F.col(c).cast("double")).otherwise(F.col(f"__out_{c}").cast("double")) for j, c in enumerate(columns)})
    mixed = mixed.withColumn("id", F.xxhash64("__key", "coalition", *(F.col(f"__out_{c}") for c in columns)))
    scored = predict(materialize(mixed.select("id", "__key", "coalition", "members", "kernel", "__weight", *columns), "coalitions"))
    values = scored.groupBy("__key", "coalition").agg((F.sum(F.col("__weight") * F.col("s")) / F.sum("__weight")).alias("v"), F.first("members").alias("members"), F.first("kernel").alias("kernel"))
    last = F.get("members", F.lit(d - 1))
    ends = [F.max(F.when(F.col("coalition") == i, F.col("v"))).alias(name) for i, name in ((0, "base"), (1, "score"))]
    # normal equations: sums against v, and against the members of the last column, which the constraint brings in
    sums = [F.sum(F.col("kernel") * (F.get("members", F.lit(j)) - last) * x).alias(f"{name}{j}") for j in range(d - 1) for name, x in (("v", F.col("v")), ("one", F.lit(1.0)), ("last", last))]
    t = values.groupBy("__key").agg(*ends, *sums)
    gap = F.col("score") - F.col("base")
    right = [F.col(f"v{j}") - F.col("base") * F.col(f"one{j}") - gap * F.col(f"last{j}") for j in range(d - 1)]
    effects = [reduce(lambda a, b: a + b, (F.lit(float(inverse[i, j])) * right[j] for j in range(d - 1))) for i in range(d - 1)]
    effects.append(reduce(lambda a, b: a - b, effects, gap))
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), e.alias("effect")) for c, e in zip(columns, effects, strict=True)))).alias("x")
    return t.select(F.col("__key").alias(key), "base", "score", named).select(key, "x.feature", "x.effect", "base", "score")


def importance(effects: DataFrame, top: int = 30) -> DataFrame:
    """``feature`` and ``mean_abs``, the mean absolute effect, of the ``top`` features (ties by name)."""
    return effects.groupBy("feature").agg(F.avg(F.abs("effect")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(top)
