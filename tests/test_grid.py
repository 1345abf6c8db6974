import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gneiss.operators import grid

CANDIDATES = [("l2", 0.001), ("l2", 1.0), ("l2", 100.0), ("l1", 0.02), ("l1", 1.0)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.5, -1.0, 0.0] + rng.logistic(size=400) > 0.8).astype(int)
    rows = [(i, int(y[i]), None if i % 17 == 0 else float(x[i, 0]), float(5 + 3 * x[i, 1]), float(x[i, 2]), "abc"[i % 3] if i % 5 else None, i % 4) for i in range(400)]
    return spark.createDataFrame(rows, "id long, target int, a double, b double, c double, k string, fold int").cache()


@pytest.fixture(scope="module")
def design(table):
    return grid.fold_features(table, "target", ["a", "b", "c"], ["k"], folds=4).cache()


@pytest.mark.parametrize("balanced", [True, False])
def test_weights_equal_a_plain_optimiser(design, balanced):
    found = grid.fit_grid(design, CANDIDATES, balanced)
    assert set(found) == {(k, c) for k in range(4) for c in range(5)}
    own = design.where("fold = 2 and not held")
    n, p = own.agg(F.count("*"), F.sum("y")).first()
    share = F.when(F.col("y") == 1, n / (2 * p)).otherwise(n / (2 * (n - p))) if balanced else F.lit(1.0)
    rows = own.select("y", array_to_vector("features").alias("features"), share.alias("share"))
    for c, (kind, value) in enumerate(CANDIDATES):
        model = LogisticRegression(labelCol="y", weightCol="share", regParam=1 / (value * n), elasticNetParam=float(kind == "l1"), standardization=False, tol=1e-13, maxIter=2000).fit(rows)
        want = np.array([*model.coefficients, model.intercept])
        x = np.column_stack([np.array([r.features for r in own.select("features").collect()]), np.ones(n)])
        assert np.allclose(x @ found[2, c], x @ want, atol=2e-4), (kind, value)


def test_the_grid_reports_means_places_and_edges(table, design):
    t = grid.grid_search(design, CANDIDATES).collect()
    assert [(r.kind, r.c) for r in t] == CANDIDATES and all(r.folds == 4 for r in t)
    weights = grid.fit_grid(design, CANDIDATES)
    scored = grid.grid_scores(design, weights).toPandas()
    for c, r in enumerate(t):
        auc = {True: [], False: []}
        for k in range(4):
            for held in auc:
                own = scored[(scored.fold == k) & (scored.candidate == c) & (scored.held == held)]
                pos, neg = own[own.y == 1].s.to_numpy(), own[own.y == 0].s.to_numpy()
                auc[held].append(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg))
        assert np.allclose([r.mean_train, r.mean_test, r.sd_test], [np.mean(auc[False]), np.mean(auc[True]), np.std(auc[True])])
        assert r.place == 1 + sum(o.mean_test > r.mean_test for o in t)
    best = [r for r in t if r.chosen]
    assert len(best) == 1 and best[0].place == 1
    assert best[0].at_edge == (best[0].c in ((0.001, 100.0) if best[0].kind == "l2" else (0.02, 1.0)))
    # one candidate of a kind is always at its edge
    assert grid.grid_search(design, [("l2", 1.0)]).first().at_edge


def test_folds_without_a_class_and_odd_input(spark, table):
    one_class = table.withColumn("fold", F.when(F.col("target") == 1, 0).otherwise(F.col("fold") % 2))
    rows = grid.fold_features(one_class, "target", ["a", "b"], folds=2)
    assert {k for k, _ in grid.fit_grid(rows, [("l2", 1.0)])} == {1}
    none = grid.grid_search(grid.fold_features(table.limit(0), "target", ["a"], folds=2), [("l2", 1.0)]).first()
    assert (none.folds, none.mean_test, none.place, none.chosen) == (0, None, None, False)
    with pytest.raises(ValueError, match="l3"):
        grid.fit_grid(rows, [("l3", 1.0)])


def test_a_step_too_long_is_halved(spark):
    rows = spark.createDataFrame([(0, False, float(i > 7), [float(i) ** 3]) for i in range(10)], "fold int, held boolean, y double, features array<double>")
    w = grid.fit_grid(rows, [("l2", 1e4)], balanced=False)[0, 0]
    x = np.array([[i**3, 1.0] for i in range(10)])
    p = 1 / (1 + np.exp(-x @ w))
    y = np.array([float(i > 7) for i in range(10)])
    slope = 1e4 * (x.T @ (p - y)) + [w[0], 0]
    assert np.abs(slope).max() < 1e-3 * 1e4
