import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import joins
from gneiss.operators.index import VectorIndex

RNG = np.random.default_rng(31)


@pytest.fixture(scope="module")
def clustered(spark):
    centres = RNG.normal(size=(60, 12))
    x = centres[RNG.integers(0, 60, 6000)] + 0.15 * RNG.normal(size=(6000, 12))
    x[4000:4300] = x[0]  # a large group of copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, (9000, None)], "id long, embedding array<double>"), x


def test_recall_from_few_rows(spark, clustered):
    points, x = clustered
    index = VectorIndex(points)
    placed = index.table
    assert placed.count() == 6000 and placed.select("id").distinct().count() == 6000
    assert index.fine.count() >= 60 and index.fine.groupBy("coarse").count().agg(F.max("count")).first()[0] <= index.root
    queries = points.where("id % 100 = 7")
    steps = index.probes_for(queries, 5).orderBy("probes").collect()
    enough = next(r for r in steps if r.enough)
    assert enough.recall >= 0.9 and enough["read"] < 0.1
    assert steps[-1].recall == 1 and steps[-1]["read"] == pytest.approx(1)
    found = index.search(queries, 5, enough.probes).collect()
    hits = 0
    for q in range(7, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        own = {r.point: r for r in found if r.query == q}
        limit = np.sort(d)[4]
        hits += sum(d[p] <= limit + 1e-9 for p in own)
        assert all(r.distance == pytest.approx(d[p]) for p, r in own.items()) and sorted(r.nth for r in own.values()) == list(range(1, len(own) + 1))
    assert hits >= 0.9 * 60 * 5


def test_all_cells_are_exact_and_small_tables_work(spark, clustered):
    few = clustered[0].where("id < 40")
    index = VectorIndex(few)
    exact = {(r.query, r.point) for r in joins.nearest(few, few, 3).collect()}
    assert {(r.query, r.point) for r in index.search(few, 3, index.fine.count()).collect()} == exact
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, embedding array<double>")
    assert VectorIndex(same).search(same, 2, 3).count() == 10
    empty = VectorIndex(same.where("false"))
    assert empty.table.count() == 0 and empty.search(same, 2, 3).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-170, 1e6, 1e160, float("inf"), float("nan")])
def test_closest_equals_differences_of_all_pairs(scale):
    y = RNG.integers(0, 4, (700, 3)) * (scale if np.isfinite(scale) else 1.0) + (1e6 if scale == 1e6 else 0.0)
    if not np.isfinite(scale):
        y[5, 1] = scale
    x = np.concatenate([y[:50], y[:50] * 1.5])
    for k in (1, 6, 700, 900):
        with np.errstate(all="ignore"):
            d = np.sqrt(((x[:, None, :] - y[None]) ** 2).sum(-1))
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        at, near, away = joins.closest(x, y, k)
        assert (at == np.repeat(np.arange(100), want.shape[1])).all() and (near == want.ravel()).all()
        assert np.array_equal(away, np.take_along_axis(d, want, 1).ravel(), equal_nan=True)


def test_closest_holds_little():
    import tracemalloc

    x, y = RNG.normal(size=(4096, 64)), RNG.normal(size=(4096, 64))
    y[:2000] = y[0]
    tracemalloc.start()
    joins.closest(x, y, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # all differences of a step took 320 MB


def test_search_makes_no_row_for_each_pair(spark, clustered, monkeypatch):
    from gneiss.operators import index as module

    monkeypatch.setattr(module, "SEARCHED", 100)
    monkeypatch.setattr(module, "ASKED", 16)
    index, queries = VectorIndex(clustered[0]), clustered[0].where("id % 100 = 7")
    got = {(r.query, r.nth): (r.point, round(r.distance, 9)) for r in index.search(queries, 5, index.fine.count()).collect()}
    exact = {(r.query, r.nth): (r.point, round(r.distance, 9)) for r in joins.nearest(queries, clustered[0], 5).collect()}
    assert got == exact
    plan = index.search(queries, 5, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan.split("FlatMapCoGroupsInPandas")[0]
