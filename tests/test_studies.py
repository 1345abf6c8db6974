"""The fitted transformer against numpy, and a study that fails, is cut off and resumed against a plain loop."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gneiss.operators import learners, metrics, studies, transformer

RNG = np.random.default_rng(21)


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i in range(420):
        a = None if RNG.random() < 0.2 else float(RNG.normal())
        b, c = float(RNG.integers(0, 5)), RNG.choice(["x", "y", "z", "rare", None], p=[0.4, 0.3, 0.2, 0.02, 0.08])
        rows.append((i, a, b, None if c is None else str(c), int((a or 0) + 0.5 * b + (c == "x") + RNG.normal() > 1.5)))
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y int")


def plain(rows, fit_rows, least=20):
    """Feature matrix of rows by plain means."""
    out = []
    for name in ("a", "b"):
        x = np.array([np.nan if r[name] is None else r[name] for r in fit_rows])
        median = np.nanmedian(x)
        x = np.where(np.isnan(x), median, x)
        out.append([((median if r[name] is None else r[name]) - x.mean()) / (x.std() or 1.0) for r in rows])
    level = lambda r: r["c"] or "unknown"
    counts = {}
    for r in fit_rows:
        counts[level(r)] = counts.get(level(r), 0) + 1
    kept = sorted(k for k, n in counts.items() if n >= least)
    for k in sorted([*kept, "pooled"]):
        out.append([float(level(r) == k if k != "pooled" else level(r) not in kept) for r in rows])
    return np.array(out).T


def test_transformer_equals_numpy_and_refits(spark, table, tmp_path):
    rows = table.orderBy("id").collect()
    dealt = table.withColumn("fold", (F.col("id") % 3).cast("int"))
    transformer.fit(dealt, ["a", "b"], ["c"], ["fold"]).write.parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    for k in range(3):
        own = [r for r in rows if r.id % 3 == k]
        cached = transformer.rows_of(states.where(F.col("fold") == k))
        refit = transformer.rows_of(transformer.fit(dealt.where(F.col("fold") == k), ["a", "b"], ["c"]))
        assert transformer.names(cached) == transformer.names(refit) and transformer.names(cached)[:2] == ["a", "b"]
        for state in (cached, refit):
            got = np.array([r.features for r in transformer.apply(table, state).orderBy("id").collect()])
            assert got == pytest.approx(plain(rows, own), abs=1e-9)


def test_transformer_of_odd_columns(spark):
    df = spark.createDataFrame([(None, 3.0, None), (None, 3.0, None)], "a double, b double, c string")
    state = transformer.rows_of(transformer.fit(df, ["a", "b"], ["c"], least=1))
    assert [list(r.features) for r in transformer.apply(df, state).collect()] == [[0.0, 0.0, 0.0, 1.0]] * 2
    assert transformer.fit(df.where("false"), ["a"], ["c"]).count() == 0


class Cut(BaseException):
    pass


def test_study_survives_failures_and_cuts(spark, table, tmp_path):
    dev, test = table.where("id < 330"), table.where("id >= 330")
    fits = {"ridge_like": studies.estimator("logistic_l2", regParam=0.05), "tree": studies.estimator("tree", maxDepth=3)}
    calls = []

    def counted(name, stop=None, fail=None):
        def fit(train):
            calls.append(name)
            if stop and len(calls) == stop:
                raise Cut
            if fail and len(calls) in fail:
                raise RuntimeError("no such luck")
            return fits[name](train)

        return fit

    def study(**how):
        return studies.Study(str(tmp_path / "study"), "id", "y", ["a", "b"], ["c"], {name: counted(name, **how) for name in fits}, outer=2, inner=2)

    with pytest.raises(Cut):
        study(stop=4, fail={2}).run(dev)
    assert sorted(r.status for r in study().runs(spark).collect()) == ["done", "done", "failed"]
    assert "no such luck" in study().runs(spark).where("status = 'failed'").first().error
    before = len(calls)
    study().run(dev)
    assert len(calls) - before == 12 - 2 and study().pending(spark) == []
    study().run(dev)
    assert len(calls) - before == 10

    rows, _ = study().prepare(dev)
    loop = []
    for name in fits:
        for k in range(2):
            for j in (-1, 0, 1):
                inside = rows.where((F.col("own") != k) & (F.col("deal") != j))
                held = rows.where((F.col("own") != k) & (F.col("deal") == j)) if j >= 0 else rows.where(F.col("own") == k)
                state = transformer.rows_of(transformer.fit(inside, ["a", "b"], ["c"]))
                ready = lambda t, state=state: t.withColumn("features", array_to_vector(transformer.features(state)))
                scored = learners.scores(fits[name](ready(inside).select("features", "y")), ready(held).select("id", "y", "features"))
                loop += [(k, j, name, r.id, round(r.s, 9)) for r in scored.collect()]
    got = [(r.outer_fold, r.inner_fold, r.candidate, r.id, round(r.s, 9)) for r in study().scores(spark).collect()]
    assert sorted(got) == sorted(loop)

    judged = study().judged(spark).collect()
    assert [r.outer_fold for r in sorted(judged, key=lambda r: r.outer_fold)] == [0, 1] and all(r.optimism == pytest.approx(r.inner_auc - r.outer_auc) for r in judged)
    once = study().final(dev, test).first()
    assert once == study(fail={len(calls) + 1}).final(dev, test).first()
    again = study().predict(test)
    assert metrics.ranking(again.select("y", "s")).first().auc == pytest.approx(once.auc) and once.n == 90
    assert once.tp + once.fp + once.fn + once.tn == 90
