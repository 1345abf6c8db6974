"""Values of what SQL can't express: recalibration, kernels, regressions, block tests and explanations against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import inference, learners, modelling, resampling
from gneiss.plans import modelling as plans

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(7)


def frame(spark, schema, *columns):
    return spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else int(v) for v in r) for r in zip(*columns, strict=True)], schema)


def test_platt_is_the_unpenalised_logistic_fit(spark):
    s = RNG.random(400).round(2)
    y = (RNG.random(400) < s * s).astype(int)
    x, w = np.column_stack([s, np.ones(400)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    df = frame(spark, "row int, s double, y int", np.arange(400), s, y)
    got = dict(modelling.recalibrated(df, df, "platt").select("row", "s").collect())
    want = 1 / (1 + np.exp(-x @ w))
    assert max(abs(got[i] - want[i]) for i in range(400)) < 1e-5


def test_isotonic_is_monotone_and_keeps_the_ends(spark):
    df = frame(spark, "s double, y int", np.array([0.1, 0.1, 0.3, 0.4, 0.6]), np.array([0, 1, 0, 1, 1]))
    more = spark.createDataFrame([(-1.0,), (0.35,), (2.0,), (None,)], "s double")
    got = modelling.recalibrated(df, more, "isotonic").collect()
    assert [r.s for r in got if r.s is not None] == pytest.approx([1 / 3, 2 / 3, 1.0]) and sum(r.s is None for r in got) == 1
    with pytest.raises(ValueError):
        modelling.recalibrated(df, more, "other")


def test_variants_and_artifact(spark):
    rows = {r.variant: r for r in plans.QUERIES["calibration_variants"](spark, SF).collect()}
    assert set(rows) == {"raw", "platt", "isotonic"}
    assert rows["platt"].brier < rows["raw"].brier and rows["isotonic"].brier < rows["raw"].brier
    saved = plans.QUERIES["model_artifact"](spark, SF).first()
    assert saved.n > 0 and saved.different == 0


@pytest.mark.parametrize("h,power", [(1, 2), (3, 1)])
def test_diebold_mariano_against_its_definition(spark, h, power):
    a, b = RNG.normal(size=60), RNG.normal(size=60)
    d = np.abs(a) ** power - np.abs(b) ** power
    c = d - d.mean()
    v = (c @ c + 2 * sum(c[k:] @ c[:-k] for k in range(1, h))) / 60 / 60
    got = inference.diebold_mariano(frame(spark, "row int, e1 double, e2 double", np.arange(60), a, b), h, power).first()
    assert got.dm == pytest.approx(d.mean() / np.sqrt(v) * np.sqrt((61 - 2 * h + h * (h - 1) / 60) / 60))


def test_block_independence_against_counts(spark):
    x = RNG.normal(size=130)
    got = {r.block: r for r in modelling.block_independence(frame(spark, "row int, x double", np.arange(130), x), 60).collect()}
    assert sorted(got) == [0, 1] and got[0].n == 60
    v, n = x[:60], 60
    near = [[abs(a - b) < 1.5 * v.std(ddof=1) for b in v] for a in v]
    share = lambda f, m, lo: sum(f(i, j) for i in range(lo, m) for j in range(i + 1, m)) / ((m - lo) * (m - lo - 1) / 2)
    c1, c1_short, c2 = share(lambda i, j: near[i][j], n, 0), share(lambda i, j: near[i][j], n, 1), share(lambda i, j: near[i][j] and near[i - 1][j - 1], n, 1)
    triples = sum(near[i][j] and near[j][k] for j in range(n) for i in range(n) for k in range(n) if len({i, j, k}) == 3) / (n * (n - 1) * (n - 2))
    assert got[0].z == pytest.approx(np.sqrt(59) * (c2 - c1_short**2) / (2 * (triples - c1 * c1)))
    short = modelling.block_independence(frame(spark, "row int, x double", np.arange(20), x[:20]), 60).collect()
    assert [r.n for r in short] == [20]
    flat = modelling.block_independence(frame(spark, "row int, x double", np.arange(20), np.ones(20)), 60).collect()
    assert flat[0].z is None


def test_support_vector_regression_is_a_minimum(spark):
    x = RNG.normal(size=(120, 2))
    y = x @ [1.5, -0.5] + 0.3 + RNG.normal(size=120) * 0.2
    w = modelling.support_vector_regression(frame(spark, "a double, b double, y double", x[:, 0], x[:, 1], y), ["a", "b"], "y", cost=1.0, epsilon=0.1)
    loss = lambda w: (w[:2] @ w[:2]) / 2 + np.maximum(np.abs(y - x @ w[:2] - w[2]) - 0.1, 0).sum()
    assert all(loss(w) <= loss(w + step) + 1e-3 for step in RNG.normal(size=(500, 3)) * 0.02)


def test_kernel_features_reproduce_the_kernel(spark):
    x = RNG.normal(size=(12, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "id int, embedding array<double>")
    base = modelling.landmarks(df, 50)
    got = {r.id: np.array(r.embedding) for r in modelling.kernel_features(df, base, 0.5).collect()}
    assert len(base) == 12 and len(got) == 12
    assert all(abs(got[i] @ got[j] - np.exp(-0.5 * ((x[i] - x[j]) ** 2).sum())) < 1e-6 for i in range(12) for j in range(12))
    assert len(modelling.landmarks(df, 5)) == 5


def test_components_keep_distances_of_a_plane(spark):
    plane = RNG.normal(size=(30, 2)) @ RNG.normal(size=(2, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(plane)], "id int, embedding array<double>")
    got = {r.id: np.array(r.embedding) for r in modelling.reduced(df, df, 2).collect()}
    assert all(np.linalg.norm(got[i] - got[0]) == pytest.approx(np.linalg.norm(plane[i] - plane[0])) for i in range(30))


def test_surrogate_of_a_linear_model_is_that_model(spark):
    cases = spark.createDataFrame([(1, 0.5, -1.0), (2, 3.0, 4.0)], "id long, a double, b double")
    predict = lambda t: t.withColumn("s", 2 * F.col("a") - 3 * F.col("b") + 1)
    got = modelling.local_surrogate(cases, {"a": (0.0, 2.0), "b": (0.0, 0.5)}, predict, draws=300)
    assert {(r.id, r.feature): round(r.effect, 6) for r in got.collect()} == {(1, "a"): 4.0, (1, "b"): -1.5, (2, "a"): 4.0, (2, "b"): -1.5}
    same = modelling.agreement(got, got.withColumn("effect", -F.col("effect")), 1).collect()
    assert [(r.shared, r.same_sign) for r in same] == [(1, 0.0), (1, 0.0)]


def test_stationary_interval_follows_dependence():
    free, slow = RNG.normal(size=2000), np.zeros(2000)
    for i in range(1, 2000):
        slow[i] = 0.9 * slow[i - 1] + free[i]
    assert resampling.block_length(slow) > 3 * resampling.block_length(free)
    mean, low, high, _ = resampling.stationary_interval(slow, n=300)
    assert low < mean < high and high - low > 3 * 3.92 * slow.std() / np.sqrt(2000) / 2
    assert resampling.block_length(np.ones(50)) == 1.0


def test_regression_by_neighbours_is_their_mean(spark):
    x = RNG.normal(size=(40, 3))
    y = RNG.normal(size=40)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id int, embedding array<double>, y double")
    got = dict(learners.knn_scores(df.where("id >= 5"), df.where("id < 5"), 4).select("id", "s").collect())
    want = {i: y[5 + np.argsort(((x[5:] - x[i]) ** 2).sum(1))[:4]].mean() for i in range(5)}
    assert all(got[i] == pytest.approx(want[i]) for i in range(5))


def test_early_stop_and_coefficients(spark):
    stopped = plans.QUERIES["boosting_early_stop"](spark, SF).first()
    assert 1 <= stopped.trees <= 20
    rows = plans.QUERIES["model_coefficients"](spark, SF).orderBy("place").collect()
    assert [abs(r.weight) for r in rows] == sorted((abs(r.weight) for r in rows), reverse=True)
    assert rows[0].zeros == sum(r.weight == 0 for r in rows)
    pairs = plans.QUERIES["collinear_coefficients"](spark, SF).collect()
    assert pairs and all(r.opposite == (r.weight_a * r.weight_b < 0) for r in pairs)


def test_early_stop_scores_all_held_out_rows(spark):
    from gneiss.plans.learning import _prepared

    got, (_, held) = plans.QUERIES["boosting_early_stop"](spark, SF).first(), _prepared(spark, SF)
    assert (got.n, got.p) == (held.count(), held.where("y = 1").count()) and 0 <= got.auc <= 1


def test_explanations_are_of_positives(spark):
    from gneiss.plans.learning import _prepared

    positive = {r.c_custkey for r in _prepared(spark, SF)[0].where("y = 1").select("c_custkey").collect()}
    got = plans.QUERIES["explanation_agreement"](spark, SF).collect()
    assert got and {r.id for r in got} <= positive and all(0 <= r.shared <= 2 and -1 <= r.rank_corr <= 1 for r in got)


def test_surrogate_of_a_constant_is_zero(spark):
    cases = spark.createDataFrame([(1, 0.3, -2.0), (2, 1.0, 0.7)], "id long, a double, b double")
    got = modelling.local_surrogate(cases, {"a": (0.0, 1.0), "b": (0.0, 1.0)}, lambda t: t.withColumn("s", F.lit(0.0803)), draws=200).collect()
    assert len(got) == 4 and all(r.effect == 0 for r in got)


def test_explanations_of_equal_scores_are_one_case(spark, monkeypatch):
    from gneiss.plans.learning import _prepared

    train, _ = _prepared(spark, SF)
    monkeypatch.setattr(plans, "_coefficients", lambda s, d: (train, None, [0.0, 0.0, 0.0, -2.4]))
    got = [r.asDict() for r in plans.QUERIES["explanation_agreement"](spark, SF).collect()]
    least = train.where("y = 1").agg(F.min("c_custkey")).first()[0]
    assert got == [{"id": least, "shared": 2, "same_sign": 1.0, "rank_corr": 1.0}]


def test_explanations_compare_contributions_of_the_case(spark, monkeypatch):
    from gneiss.plans.learning import NUMBERS, _prepared

    train, _ = _prepared(spark, SF)
    weights = np.array([1.0, 0.5, 0.2])  # the surrogate has their order and signs
    monkeypatch.setattr(plans, "_coefficients", lambda s, d: (train, None, [*weights.tolist(), -0.3]))
    rows = sorted((float(weights @ [r[c] for c in NUMBERS]), r.c_custkey, weights * [r[c] for c in NUMBERS]) for r in train.where("y = 1").collect())
    got = {r.id: (r.shared, r.same_sign, r.rank_corr) for r in plans.QUERIES["explanation_agreement"](spark, SF).collect()}
    want = {}
    for _, key, parts in (rows[0], rows[-1]):
        place = np.argsort(np.argsort(-np.abs(parts)))
        want[key] = (int((place[:2] < 2).sum()), np.mean(parts > 0), np.corrcoef(place, range(3))[0, 1])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def test_artifact_scores_all_held_out_rows(spark):
    from gneiss.plans.learning import _prepared

    got = plans.QUERIES["model_artifact"](spark, SF).first()
    assert (got.n, got.different) == (_prepared(spark, SF)[1].count(), 0)
