"""Classifiers and regressors: closed forms as aggregations, the rest from Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as cls
from pyspark.ml import regression as reg
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators.joins import nearest


def naive_bayes(train: DataFrame, rows: DataFrame, columns: Sequence[str], target: str, smoothing: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes score of each row: log odds of class 1.

    Means and population variances come from one aggregation; every variance
    gets ``smoothing`` times the largest variance of a column. Missing values
    of a row add nothing.
    """
    stats = train.groupBy(target).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.var_pop(c).alias(f"v_{c}") for c in columns)).collect()
    wide = train.agg(*(F.var_pop(c).alias(c) for c in columns)).first()
    extra = smoothing * max((wide[c] or 0.0) for c in columns)
    by = {r[target]: r for r in stats}
    if set(by) < {0, 1}:
        raise ValueError("both classes are needed")
    odds = F.lit(math.log(by[1]["n"] / by[0]["n"]))
    for c in columns:
        parts = []
        for k in (1, 0):
            v = (by[k][f"v_{c}"] or 0.0) + extra
            parts.append(-0.5 * F.log(F.lit(v)) - (F.col(c) - by[k][f"m_{c}"]) * (F.col(c) - by[k][f"m_{c}"]) / (2 * v))
        odds = odds + F.coalesce(parts[0] - parts[1], F.lit(0.0))
    return rows.withColumn("s", odds)


def knn_scores(train: DataFrame, rows: DataFrame, k: int, weights: str = "uniform", positive: float = 1.0) -> DataFrame:
    """Mean of ``y`` of the k nearest training rows; with "distance", weighted by 1 / (d + 1e-6).

    Rows of class 1 weigh ``positive`` times as much. For other values of
    ``y`` the mean is a regression.
    """
    near = nearest(rows.select("id", "embedding"), train.select("id", "embedding"), k).join(train.select(F.col("id").alias("point"), "y"), "point")
    w = F.lit(1.0) if weights == "uniform" else 1 / (F.col("distance") + 1e-6)
    w = w * F.when(F.col("y") == 1, positive).otherwise(1.0) if positive != 1.0 else w
    return near.groupBy(F.col("query").alias("id")).agg((F.sum(w * F.col("y")) / F.sum(w)).alias("s"))


def learner(name: str, columns: Sequence[str], target: str, weight: str | None = None, **params) -> Pipeline:
    """A named learner over numeric columns (without missing values) as a Spark ML pipeline."""
    made = {
        "logistic_l1": lambda: cls.LogisticRegression(elasticNetParam=1.0, standardization=False),
        "logistic_l2": lambda: cls.LogisticRegression(elasticNetParam=0.0, standardization=False),
        "tree": lambda: cls.DecisionTreeClassifier(seed=42),
        "forest": lambda: cls.RandomForestClassifier(seed=42),
        "boosting": lambda: cls.GBTClassifier(seed=42),
        "svm": lambda: cls.LinearSVC(standardization=False),
        "ridge": lambda: reg.LinearRegression(elasticNetParam=0.0, standardization=False),
        "lasso": lambda: reg.LinearRegression(elasticNetParam=1.0, standardization=False),
        "tree_regression": lambda: reg.DecisionTreeRegressor(seed=42),
        "forest_regression": lambda: reg.RandomForestRegressor(seed=42),
        "boosting_regression": lambda: reg.GBTRegressor(seed=42),
    }[name]()
    made = made.setFeaturesCol("features").setLabelCol(target)
    if weight:
        made = made.setWeightCol(weight)
    made = made.copy({made.getParam(key): value for key, value in params.items()})
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), made])


def scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``s``: probability of class 1 where the model has one, else its raw score or prediction."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    if "probability" in out.columns:
        s = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        s = vector_to_array("rawPrediction")[1]
    else:
        s = F.col("prediction")
    return out.withColumn("s", s).drop("features", "probability", "rawPrediction", "prediction")


def adversarial_auc(train: DataFrame, test: DataFrame, columns: Sequence[str], folds: int = 5, **params) -> DataFrame:
    """AUC of a boosted classifier that tells train rows from test rows, out of fold.

    Missing values count as the column's least value minus one.
    """
    from functools import reduce

    from gneiss.functions.columns import hash_order
    from gneiss.operators.metrics import ranking

    both = train.select(*columns, F.lit(0).alias("y")).unionByName(test.select(*columns, F.lit(1).alias("y")))
    low = both.agg(*(F.min(c).alias(c) for c in columns)).first()
    filled = both.select("y", *(F.coalesce(F.col(c).cast("double"), F.lit((low[c] or 0) - 1.0)).alias(c) for c in columns))
    dealt = filled.withColumn("fold", F.pmod(F.xxhash64(hash_order(*columns)), F.lit(folds)))
    parts = [scores(learner("boosting", columns, "y", **params).fit(dealt.where(F.col("fold") != k)), dealt.where(F.col("fold") == k)) for k in range(folds)]
    return ranking(reduce(DataFrame.unionByName, parts))


def cell_centres(points: DataFrame, sample: int, per_cell: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Centres of k-means cells over at most ``sample`` vectors of ``id``, ``embedding``, those of the smallest hash.

    The sample is bounded by its parameter; every vector is placed by the
    cells afterwards. An empty table gives one cell at the origin of no axes.
    """
    rows = points.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
    if not rows:
        return np.zeros((1, 0))
    x = np.array([r.embedding for r in rows], np.float64)
    k = max(1, len(x) // per_cell)
    centres = x[np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        centres = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
    return centres
