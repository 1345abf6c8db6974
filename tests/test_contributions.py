"""Contributions against sums over all subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import contributions as C
from gneiss.operators import learners

COLUMNS = ["a", "b", "c", "e"]


def shapley(value, d):
    out = np.zeros(d)
    for j in range(d):
        rest = [i for i in range(d) if i != j]
        for k in range(d):
            for s in combinations(rest, k):
                out[j] += factorial(k) * factorial(d - k - 1) / factorial(d) * (value({*s, j}) - value(set(s)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=300) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, e double, y int")


def expected(nodes, row, known):
    """Margin where columns outside ``known`` follow the training rows."""
    by = {(n.tree, n.node): n for n in nodes}

    def down(n):
        if n.left < 0:
            return n.value
        left, right = by[n.tree, n.left], by[n.tree, n.right]
        if n.feature in known:
            return down(left if row[n.feature] <= n["values"][0] else right)
        return (left.cover * down(left) + right.cover * down(right)) / n.cover

    return sum(n.weight * down(n) for n in nodes if n.node == 0)


MODELS = {"tree": {"maxDepth": 6}, "forest": {"numTrees": 7, "maxDepth": 5}, "boosting": {"maxIter": 6, "maxDepth": 4}, "tree_regression": {"maxDepth": 5}, "forest_regression": {"numTrees": 5}, "boosting_regression": {"maxIter": 4}}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_tree_contributions(spark, rows, name):
    model = learners.learner(name, COLUMNS, "y", **MODELS[name]).fit(rows)
    got = C.tree_contributions(model, rows.withColumn("margin", F.lit("x")), COLUMNS).orderBy("id").collect()
    scored = {r.id: r for r in model.transform(rows).collect()}
    nodes = C.node_table(model).collect()
    assert len(got) == 300
    for r in got:
        assert r.margin == pytest.approx(r.base + sum(r.effects))
        own = scored[r.id]
        assert r.margin == pytest.approx(own.prediction if "regression" in name else own.probability[1] if name != "boosting" else np.log(own.probability[1] / own.probability[0]) / 2)
    for r in got[:12]:
        x = [r[c] for c in COLUMNS]
        assert r.effects == pytest.approx(shapley(lambda s, x=x: expected(nodes, x, s), 4))


def test_categories_go_left_by_membership(spark):
    data = spark.createDataFrame([(i, float(i % 4), float(i % 7), int(i % 4 in (0, 3))) for i in range(200)], "id long, k double, v double, y int")
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler, VectorIndexer

    model = Pipeline(stages=[VectorAssembler(inputCols=["k", "v"], outputCol="raw"), VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4), DecisionTreeClassifier(featuresCol="features", labelCol="y", maxDepth=3)]).fit(data)
    assert any(n.categories == 4 for n in C.node_table(model).collect())
    got = C.tree_contributions(model, data, ["k", "v"]).collect()
    assert all(r.margin == r.y and r.effects[1] == 0 for r in got)


def test_linear_model_gives_the_linear_formula(spark, rows):
    weight = dict(zip(COLUMNS, (2.0, -1.0, 0.5, 0.0), strict=True))
    around = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 0.25), (-1.0, 0.0, 1.0, 2.0, 0.75)], "a double, b double, c double, e double, weight double")
    mean = {c: 0.25 * x + 0.75 * y for c, x, y in zip(COLUMNS, (1, 2, 3, 4), (-1, 0, 1, 2), strict=True)}
    predict = lambda t: t.withColumn("s", sum(weight[c] * F.col(c) for c in COLUMNS))
    for number in (None, 400):
        got = C.model_contributions(rows.limit(40), "id", COLUMNS, around, predict, number).join(rows, "id").collect()
        assert len(got) == 160
        for r in got:
            assert r.effect == pytest.approx(weight[r.feature] * (r[r.feature] - mean[r.feature]), abs=1e-9)
            assert r.base == pytest.approx(sum(weight[c] * mean[c] for c in COLUMNS)) and r.score == pytest.approx(sum(weight[c] * r[c] for c in COLUMNS))


def test_neighbours_against_all_subsets(spark, rows):
    vector = F.array(*COLUMNS)
    train = rows.select(F.col("id"), vector.alias("embedding"), "y")
    points = rows.orderBy("id").collect()
    x, y = np.array([[r[c] for c in COLUMNS] for r in points]), np.array([r.y for r in points])
    around = C.background(rows, COLUMNS, 4)
    centres = around.collect()
    assert len(centres) == 4 and sum(r.weight for r in centres) == pytest.approx(1)

    def predict(t):
        found = learners.knn_scores(train.withColumn("id", -F.col("id") - 1), t.select("id", vector.alias("embedding")), 5)
        return t.join(found, "id")

    def score(v):
        return y[np.argsort(((x - v) ** 2).sum(1), kind="stable")[:5]].mean()

    cases = rows.where("id < 3")
    got = C.model_contributions(cases, "id", COLUMNS, around, predict).collect()
    for i in range(3):
        def value(s, i=i):
            return sum(r.weight * score(np.array([x[i][j] if j in s else r[c] for j, c in enumerate(COLUMNS)])) for r in centres)

        want = shapley(value, 4)
        own = {r.feature: r.effect for r in got if r.id == i}
        assert [own[c] for c in COLUMNS] == pytest.approx(want, abs=1e-9)


def test_one_column_and_no_cases(spark, rows):
    around = C.background(rows, ["a"], 3)
    predict = lambda t: t.withColumn("s", F.exp("a"))
    assert C.model_contributions(rows.where("false"), "id", ["a"], around, predict).count() == 0
    got = C.model_contributions(rows.limit(5), "id", ["a"], around, predict).collect()
    assert all(r.effect == pytest.approx(r.score - r.base) for r in got) and len(got) == 5
    assert C.importance(C.model_contributions(rows.limit(5), "id", ["a", "b"], C.background(rows, ["a", "b"], 3), predict)).first().feature == "a"


SF = "/root/testdata/sf0.001"


def test_prepared_rows_keep_their_key(spark):
    from gneiss.plans import frames, learning

    train, test = learning._prepared(spark, SF)
    keys = [r.c_custkey for part in (train, test) for r in part.select("c_custkey").collect()]
    assert sorted(keys) == sorted(r.c_custkey for r in frames.clients(spark, SF).select("c_custkey").collect())


def _test_keys(spark):
    from gneiss.plans import learning

    return sorted(r.c_custkey for r in learning._prepared(spark, SF)[1].select("c_custkey").collect())


def test_model_contributions_query_adds_up_for_every_test_row(spark):
    from gneiss.plans import explanations

    got = explanations.QUERIES["model_contributions"](spark, SF).groupBy("c_custkey").agg(F.sum("effect").alias("sum"), F.first("score").alias("score"), F.first("base").alias("base"), F.count("*").alias("n")).collect()
    assert sorted(r.c_custkey for r in got) == _test_keys(spark)
    assert all(r.n == 3 and r.base + r.sum == pytest.approx(r.score, abs=1e-5) for r in got)


def test_tree_contributions_query_adds_up_for_every_test_row(spark):
    from gneiss.plans import explanations

    got = explanations.QUERIES["tree_contributions"](spark, SF).groupBy("model", "c_custkey").agg(F.sum("effect").alias("sum"), F.first("margin").alias("margin"), F.first("base").alias("base"), F.count("*").alias("n")).collect()
    assert all(r.n == 3 and r.base + r.sum == pytest.approx(r.margin, abs=1e-5) for r in got)
    assert {m: sorted(r.c_custkey for r in got if r.model == m) for m in ("boosting", "forest")} == dict.fromkeys(("boosting", "forest"), _test_keys(spark))


def test_tree_importance_query_has_every_column_and_no_gap(spark):
    from gneiss.plans import explanations
    from gneiss.plans.learning import NUMBERS

    got = explanations.QUERIES["tree_importance"](spark, SF).collect()
    assert sorted((r.model, r.feature) for r in got) == sorted((m, c) for m in ("boosting", "forest") for c in NUMBERS)
    assert all(r.gap < 1e-5 and r.mean_abs >= 0 for r in got)
