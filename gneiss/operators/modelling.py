"""Models fitted and judged in nested folds, recalibration, kernels and explanations.

Fits that differ only in the rows they see are one aggregation: each row is
expanded to the fits it belongs to and summed before the shuffle, so the number
of jobs doesn't grow with the number of folds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import classification as cls
from pyspark.ml import regression as reg
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.columns import uniform
from gneiss.functions.distributions import normal_two_sided
from gneiss.operators import inference, metrics, order, splits
from gneiss.operators.products import matrix_sums
from gneiss.sources.storage import materialize


def class_stats(columns: Sequence[str], target: str) -> list[Column]:
    """Numbers of both classes, and the means and variances that :func:`log_odds` needs."""
    own = lambda k, c: F.when(F.col(target) == k, F.col(c))
    counts = [F.count(F.when(F.col(target) == k, 1)).alias(f"n_{k}") for k in (0, 1)]
    return counts + [f(own(k, c)).alias(f"{n}_{k}_{c}") for k in (0, 1) for c in columns for n, f in (("m", F.avg), ("v", F.var_pop))] + [F.var_pop(c).alias(f"w_{c}") for c in columns]


def log_odds(columns: Sequence[str], smoothing: float) -> Column:
    """Gaussian naive Bayes from the columns of :func:`class_stats`; missing values of a row add nothing."""
    widest = reduce(lambda a, b: F.greatest(a, b), (F.col(f"w_{c}") for c in columns))
    out = F.log(F.col("n_1") / F.col("n_0"))
    for c in columns:
        part = []
        for k in (1, 0):
            v = F.col(f"v_{k}_{c}") + smoothing * widest
            part.append(-F.log(v) / 2 - (F.col(c) - F.col(f"m_{k}_{c}")) * (F.col(c) - F.col(f"m_{k}_{c}")) / (2 * v))
        out = out + F.coalesce(part[0] - part[1], F.lit(0.0))
    return out


def nested_scores(df: DataFrame, key: str, target: str, candidates: dict[str, Sequence[str]], outer: int = 5, inner: int = 3, smoothing: float = 1e-9) -> DataFrame:
    """Scores of every candidate (a set of columns of a naive Bayes model) in all nested folds.

    Rows are dealt in turn within each class to ``outer`` times ``inner``
    cells. The fit (k, j) leaves out outer fold k and inner fold j and scores
    j within the rest; (k, -1) is fitted on all but k and scores k. Returns
    ``outer_fold``, ``inner_fold``, ``candidate``, ``y``, ``s``.
    """
    columns = sorted({c for own in candidates.values() for c in own})
    dealt = splits.stratified(df.select(key, target, *columns), key, target, {"all": 1.0}, folds=outer * inner)
    cells = dealt.select(target, *columns, (F.col("fold") % outer).alias("own"), F.floor(F.col("fold") / outer).alias("deal"))
    fits = F.array(*(F.struct(F.lit(k).alias("outer_fold"), F.lit(j).alias("inner_fold")) for k in range(outer) for j in range(-1, inner)))
    roles = cells.withColumn("fit", F.explode(fits)).select("*", "fit.*").drop("fit")
    outside, k, j = F.col("own") != F.col("outer_fold"), F.col("outer_fold"), F.col("inner_fold")
    stats = roles.where(outside & (F.col("deal") != j)).groupBy("outer_fold", "inner_fold").agg(*class_stats(columns, target))
    held = roles.where(F.when(j == -1, F.col("own") == k).otherwise(outside & (F.col("deal") == j))).join(F.broadcast(stats), ["outer_fold", "inner_fold"])  # a row for each fit
    found = F.array(*(F.struct(F.lit(name).alias("candidate"), log_odds(own, smoothing).alias("s")) for name, own in candidates.items()))
    return held.select("outer_fold", "inner_fold", F.col(target).alias("y"), F.explode(found).alias("c")).select("outer_fold", "inner_fold", "y", "c.*")


def nested_study(df: DataFrame, key: str, target: str, candidates: dict[str, Sequence[str]], cost_fn: float = 10.0, **folds) -> DataFrame:
    """For each outer fold: the candidate of the best mean inner AUC, its threshold of least cost and its outer AUC.

    The threshold is that of the inner scores, which no fit has seen. Equal
    means go to the candidate of the later name.
    """
    return judged_scores(materialize(nested_scores(df, key, target, candidates, **folds), "nested_scores"), cost_fn)


def judged_scores(s: DataFrame, cost_fn: float = 10.0) -> DataFrame:
    """The same from scores (``outer_fold``, ``inner_fold``: -1 for the outer fit, ``candidate``, ``y``, ``s``) of any learners."""
    auc = materialize(metrics.ranking(s, ["outer_fold", "inner_fold", "candidate"]), "nested_auc")
    means = auc.where("inner_fold >= 0").groupBy("outer_fold", "candidate").agg(F.avg("auc").alias("inner_auc"))
    best = means.groupBy("outer_fold").agg(F.max(F.struct("inner_auc", "candidate")).alias("b")).select("outer_fold", "b.*")
    kept = ["outer_fold", "candidate"]
    limits = metrics.best_thresholds(s.where("inner_fold >= 0").join(best, kept, "left_semi"), cost_fn, ["outer_fold"])
    outer = auc.where("inner_fold = -1").select(*kept, F.col("auc").alias("outer_auc"))
    return best.join(outer, kept).join(limits, "outer_fold").select(*kept, "inner_auc", "outer_auc", (F.col("inner_auc") - F.col("outer_auc")).alias("optimism"), "cost_threshold", "cost")


def final_evaluation(dev: DataFrame, test: DataFrame, key: str, target: str, candidates: dict[str, Sequence[str]], smoothing: float = 1e-9, **study) -> DataFrame:
    """One evaluation on test rows of the candidate whose fold has the best inner AUC, refitted on all of ``dev``.

    The threshold is the median of the folds' thresholds; where no fold has
    one, nothing is called positive.
    """
    folds = nested_study(dev, key, target, candidates, smoothing=smoothing, **study).collect()  # a row for each outer fold
    chosen = max(folds, key=lambda r: (r.inner_auc, -r.outer_fold)).candidate
    limits = sorted(r.cost_threshold for r in folds if r.cost_threshold is not None)
    limit = float(np.median(limits)) if limits else float("inf")
    columns = list(candidates[chosen])
    scored = test.crossJoin(F.broadcast(dev.where(F.col(target).isNotNull()).agg(*class_stats(columns, target)))).select(F.col(target).alias("y"), log_odds(columns, smoothing).alias("s"))  # one row of statistics
    return metrics.ranking(scored).crossJoin(metrics.confusion(scored, limit)).select(F.lit(chosen).alias("candidate"), "n", "auc", "ap", "tp", "fp", "fn", "tn")


def recalibrated(fit: DataFrame, rows: DataFrame, method: str) -> DataFrame:
    """``rows`` with ``s`` recalibrated by "platt" (logistic, no penalty) or "isotonic" (limited to the fitted range), fitted on ``y``, ``s`` of ``fit``.

    The fit needs one row for each distinct score and class.
    """
    known = fit.where("y is not null and s is not null")
    if method == "platt":
        counts = known.groupBy("s", "y").agg(F.count("*").cast("double").alias("n"))
        made = cls.LogisticRegression(featuresCol="features", labelCol="y", weightCol="n", tol=1e-10, maxIter=200, standardization=False)
        shaped = VectorAssembler(inputCols=["s"], outputCol="features")
        m = made.fit(shaped.transform(counts))
        return rows.withColumn("s", 1 / (1 + F.exp(-(F.lit(float(m.intercept)) + F.lit(float(m.coefficients[0])) * F.col("s")))))
    if method != "isotonic":
        raise ValueError(method)
    counts = known.groupBy("s").agg(F.count("*").cast("double").alias("n"), F.avg("y").alias("y"))
    m = reg.IsotonicRegression(featuresCol="s", labelCol="y", weightCol="n").fit(counts)
    known_rows = m.setPredictionCol("__s").transform(rows.where("s is not null")).withColumn("s", F.col("__s")).drop("__s")
    return known_rows.unionByName(rows.where("s is null"))


def recalibrated_out_of_fold(df: DataFrame, method: str, fold: str = "fold") -> DataFrame:
    """Every fold's scores recalibrated by a fit on the other folds."""
    numbers = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]  # a few folds
    return reduce(DataFrame.unionByName, (recalibrated(df.where(F.col(fold) != k), df.where(F.col(fold) == k), method) for k in numbers))


def delong_interval(df: DataFrame, score: str, level_z: float = 1.959963984540054) -> DataFrame:
    """AUC of a score with DeLong's standard error and the normal interval, cut at 0 and 1."""
    rows = df.where(F.col("y").isNotNull() & F.col(score).isNotNull())
    counts = materialize(rows.groupBy(F.col(score).alias("s")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")), "equal_scores")
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("y"), F.col(n).alias("n"), F.col(v).alias("v")) for k, n, v in ((1, "pos", "v1"), (0, "neg", "v0"))))).alias("c")
    placed = inference.placements(counts, "s").select(sides).select("c.*").where("n > 0")
    n = F.col("n")
    t = placed.groupBy("y").agg((F.sum(n * F.col("v")) / F.sum(n)).alias("auc"), inference.weighted_variance(F.col("v"), n).alias("d"), F.sum(n).alias("k"))
    t = t.agg(F.max(F.when(F.col("y") == 1, F.col("auc"))).alias("auc"), F.sqrt(F.sum(F.col("d") / F.col("k"))).alias("se"))
    return t.select("auc", "se", F.greatest(F.col("auc") - level_z * F.col("se"), F.lit(0.0)).alias("low"), F.least(F.col("auc") + level_z * F.col("se"), F.lit(1.0)).alias("high"))


def normality(df: DataFrame) -> DataFrame:
    """D'Agostino's skewness and kurtosis scores of ``x`` and their omnibus K2, from four moments; null under 8 rows or without spread."""
    t = df.agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("g1"), (F.kurtosis("x") + 3).alias("b2")).where("n >= 8 and not isnan(g1)")
    n, root = F.col("n"), F.sqrt
    y = F.col("g1") * root((n + 1) * (n + 3) / (6 * (n - 2)))
    spread = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = root(2 * (spread - 1)) - 1
    z1 = F.asinh(y / root(2 / (w2 - 1))) / root(F.log(w2) / 2)
    x = (F.col("b2") - 3 * (n - 1) / (n + 1)) / root(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * root(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + root(1 + 4 / (third * third)))
    base = (1 - 2 / a) / (1 + x * root(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.cbrt(base)) / root(2 / (9 * a))
    return t.select("n", "g1", (F.col("b2") - 3).alias("excess"), z1.alias("z_skew"), z2.alias("z_kurtosis"), (z1 * z1 + z2 * z2).alias("k2"))


def block_independence(df: DataFrame, size: int = 5000) -> DataFrame:
    """BDS statistic (two dimensions, radius of 1.5 deviations) of ``x`` in every block of ``size`` rows in the order of ``row``.

    Blocks bound the pairs: each is one group of ``size`` rows. As the test
    is of blocks of one size, a shorter last block is left out unless it is
    the only one. Returns ``block``, ``n``, ``z`` and its two-sided ``p`` (null
    without spread); :func:`inference.combined_p` puts blocks together.
    """
    known = order.positions(df.where("x is not null").select("row", "x"), F.col("row"), name="pos")
    n = known.count()
    whole = known.withColumn("block", F.floor(F.col("pos") / size)).where(F.col("block") < max(n // size, 1))

    def statistic(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("pos")["x"].to_numpy()
        m = len(x)
        near = np.abs(x[:, None] - x[None, :]) < 1.5 * x.std(ddof=1) if m > 3 else np.zeros((m, m), bool)
        pairs = lambda b: (b.sum() - len(b)) / (len(b) * (len(b) - 1.0))
        z = None
        if m > 3 and near.any():
            reach = near.sum(axis=1, dtype=np.float64)
            c = pairs(near)
            k = ((reach * reach).sum() - 3 * reach.sum() + 2 * m) / (m * (m - 1.0) * (m - 2.0))
            if k > c * c:
                z = math.sqrt(m - 1) * (pairs(near[1:, 1:] & near[:-1, :-1]) - pairs(near[1:, 1:]) ** 2) / (2 * (k - c * c))
        return pd.DataFrame({"block": [key[0]], "n": [m], "z": [z], "p": [None if z is None else max(normal_two_sided(z), 1e-300)]})

    return whole.groupBy("block").applyInPandas(statistic, "block long, n long, z double, p double")


def support_vector_regression(df: DataFrame, columns: Sequence[str], target: str, cost: float = 1.0, epsilon: float = 0.1, rounds: int = 100, tolerance: float = 1e-7) -> np.ndarray:
    """Weights (and the intercept, last) of a linear regression under the epsilon-insensitive loss.

    Minimises |w|^2 / 2 + cost * sum(max(0, |y - f| - epsilon)), the
    intercept unpenalised. The loss is half the sum of |r - epsilon| and
    |r + epsilon|; each round replaces both by the parabola that touches them
    at the current residual, so it is one sum of weighted matrices.
    """
    rows = materialize(df.select(*(F.col(c).cast("double") for c in columns), F.col(target).cast("double").alias("__y")).dropna(), "regression_rows")
    d = len(columns) + 1
    w, penalty = np.zeros(d), np.diag([1.0] * (d - 1) + [0.0])
    for _ in range(rounds):

        def touching(batch: np.ndarray, w: np.ndarray = w) -> dict[str, np.ndarray]:
            x, y = np.column_stack([batch[:, :-1], np.ones(len(batch))]), batch[:, -1]
            r = y - x @ w
            up, down = (1 / (2 * np.maximum(np.abs(r + e), 1e-8)) for e in (-epsilon, epsilon))
            return {"gram": x.T @ (x * (up + down)[:, None]), "right": (x.T @ ((up + down) * y - epsilon * (up - down)))[:, None]}

        s = matrix_sums(rows, [*columns, "__y"], touching)
        if not s:
            return w
        new = np.linalg.lstsq(penalty + cost * s["gram"], cost * s["right"][:, 0], rcond=None)[0]
        step, w = np.abs(new - w).max(), new
        if step < tolerance:
            break
    return w


def landmarks(df: DataFrame, number: int, vector: str = "embedding") -> np.ndarray:
    """At most ``number`` distinct vectors, those of the smallest hash of the vector: the bounded sample of a kernel map."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(number).collect()
    return np.array([r.v for r in rows], np.float64)


def kernel_features(df: DataFrame, base: np.ndarray, gamma: float, vector: str = "embedding") -> DataFrame:
    """Nystroem features of the radial kernel exp(-gamma |x - l|^2) to the landmarks ``base``, in place of the vector."""
    square = lambda a: (a * a).sum(axis=1)
    kernel = lambda a: np.exp(-gamma * np.maximum(square(a)[:, None] - 2 * a @ base.T + square(base)[None], 0))
    u, s, v = np.linalg.svd(kernel(base))
    whiten = (u / np.sqrt(np.maximum(s, 1e-12))) @ v

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(kernel(np.stack(x)) @ whiten) if len(x) else [], dtype=object)

    return df.where(F.col(vector).isNotNull()).withColumn(vector, features(F.col(vector).cast("array<double>")))


def reduced(fit: DataFrame, df: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """Vectors as their first ``k`` principal components of ``fit``."""
    as_vector = lambda t: t.where(F.col(vector).isNotNull()).withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(as_vector(fit))
    return model.transform(as_vector(df)).withColumn(vector, vector_to_array("__p")).drop("__v", "__p")


def local_surrogate(cases: DataFrame, stats: dict[str, tuple[float, float]], predict: Callable[[DataFrame], DataFrame], draws: int = 5000, seed: int = 42) -> DataFrame:
    """Linear explanation of a model around each of a few cases (``id`` and the columns of ``stats``).

    Columns are drawn around the case with their deviation; ``predict`` adds
    ``s``; draws near the case weigh more (width 0.75 times the root of the
    number of columns). Products are summed in Spark; only a small system for
    each case is solved here. Scores count from that of the case, so a constant
    one gives effects of exactly 0. ``id`` must be unique. Returns ``id``,
    ``feature``, ``effect`` per deviation.
    """
    columns = list(stats)
    angle = lambda c: F.sqrt(-2 * F.log(1 - uniform("id", "draw", F.lit(c), seed=seed))) * F.cos(2 * math.pi * uniform("id", "draw", F.lit(c), seed=seed + 1))
    drawn = cases.select("id", *columns).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumns({f"z_{c}": angle(c) for c in columns})
    drawn = drawn.withColumns({c: F.col(c) + F.lit(float(stats[c][1])) * F.col(f"z_{c}") for c in columns})
    own = predict(cases.select("id", *columns)).select("id", F.col("s").alias("__own"))
    scored = predict(drawn).join(F.broadcast(own), "id").withColumn("s", F.col("s") - F.col("__own"))  # a few cases
    z = [F.col(f"z_{c}") for c in columns] + [F.lit(1.0)]
    near = F.exp(-reduce(lambda a, b: a + b, (c * c for c in z[:-1])) / (0.75 * 0.75 * len(columns)))
    cells = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = scored.groupBy("id").agg(*(F.sum(near * z[i] * z[j]).alias(f"g{i}_{j}") for i, j in cells), *(F.sum(near * z[i] * F.col("s")).alias(f"y{i}") for i in range(len(z)))).collect()
    out = []
    for r in sums:
        gram = np.zeros((len(z), len(z)))
        for i, j in cells:
            gram[i, j] = gram[j, i] = r[f"g{i}_{j}"]
        effects = np.linalg.lstsq(gram, np.array([r[f"y{i}"] for i in range(len(z))]), rcond=None)[0]
        out += [(r.id, c, float(e)) for c, e in zip(columns, effects, strict=False)]
    return cases.sparkSession.createDataFrame(out, "id long, feature string, effect double")


def agreement(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """For each ``id`` of two explanations (``feature``, ``effect``): shared features among the ``top`` of each, and the share of features of equal sign."""
    from pyspark.sql import Window

    def ranked(df: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.abs("effect")), "feature"))
        return df.select("id", "feature", F.col("effect").alias(name), place.alias(f"{name}_place"))

    both = ranked(a, "left").join(ranked(b, "right"), ["id", "feature"])
    shared = F.sum(F.when((F.col("left_place") <= top) & (F.col("right_place") <= top), 1).otherwise(0))
    return both.groupBy("id").agg(shared.alias("shared"), F.avg((F.signum("left") == F.signum("right")).cast("int")).alias("same_sign"), F.corr("left_place", "right_place").alias("rank_corr"))
