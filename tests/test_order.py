import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss import catalog
from gneiss.operators import joins, order
from gneiss.operators.learners import cell_centres
from gneiss.sources import formats, storage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    return [(i, rng.randint(0, 40), rng.choice("ab")) for i in range(500)]


def test_positions_and_running_sums(spark, rows):
    df = spark.createDataFrame(rows, "k long, v int, g string")
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.k: r.pos for r in order.positions(df, F.col("v"), F.col("k")).collect()} == want
    sums = {r.k: r.s for r in order.running(df, [F.desc("k")], {"s": F.col("v")}, ["g"]).collect()}
    assert sums == {k: sum(v for j, v, h in rows if h == g and j >= k) for k, _, g in rows}
    assert order.positions(df.limit(0), F.col("k")).count() == 0


@pytest.mark.parametrize("bins", [3, 7, 499, 500, 600])
def test_bins_equal_ntile(spark, rows, bins):
    from pyspark.sql import Window

    df = spark.createDataFrame(rows, "k long, v int, g string")
    got = {r.k: r.bin for r in order.equal_count_bins(df, bins, F.col("v"), F.col("k")).collect()}
    assert got == {r.k: r.b for r in df.withColumn("b", F.ntile(bins).over(Window.orderBy("v", "k"))).collect()}


def test_lags_cross_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 7)
    got = {r.k: (r.lag_1, r.lag_5) for r in order.lagged(spark.createDataFrame(rows, "k long, v int, g string"), "k", "v", [1, 5]).collect()}
    v = [r[1] for r in rows]
    assert got == {i: (v[i - 1] if i else None, v[i - 5] if i >= 5 else None) for i in range(500)}
    with pytest.raises(ValueError, match="under"):
        order.lagged(spark.createDataFrame(rows, "k long, v int, g string"), "k", "v", [7])


def test_ranks_average_ties(spark, rows):
    got = {r.k: r.rank_avg for r in order.tie_ranks(spark.createDataFrame(rows, "k long, v int, g string"), "v", ["g"]).collect()}
    for k, v, g in rows[:60]:
        own = [w for _, w, h in rows if h == g]
        assert got[k] == sum(w < v for w in own) + (sum(w == v for w in own) + 1) / 2


def test_cells_find_most_neighbours_and_the_exact_way_all(spark):
    points = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    x = {r.id: r.embedding for r in points.collect()}
    ids, m = np.array(sorted(x)), np.array([x[i] for i in sorted(x)])
    found = catalog.queries()["nearest_by_cells"](spark, "/root/testdata/sf0.1").collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.linalg.norm(m - np.array(x[q]), axis=1)
        best = [int(i) for i in ids[np.argsort(d, kind="stable")] if i != q][:5]
        hits += len({r.point for r in found if r.query == q} & set(best))
        total += 5
    assert hits >= 0.9 * total
    few = points.where("id < 300")
    exact = {(r.query, r.point) for r in joins.nearest(few.where("id % 100 = 0"), few, 5).collect()}
    centres = cell_centres(few, 100, 25)
    assert {(r.query, r.point) for r in joins.nearest_cells(few.where("id % 100 = 0"), few, 5, centres, len(centres)).collect()} == exact


def test_queries_without_sql_give_sound_values(spark):
    q = lambda name: catalog.queries()[name](spark, SF).collect()
    assert all(0 <= r.p <= 1 for r in q("nemenyi")) and len(q("nemenyi")) == 10
    low = q("auc_interval")[0]
    assert low.low <= low.auc <= low.high
    adversarial = q("adversarial_auc")
    assert all(0 <= v <= 1 for r in adversarial for v in r.asDict().values() if isinstance(v, float))
    history = q("search_history")
    for method in {r.method for r in history}:
        own = sorted((r for r in history if r.method == method), key=lambda r: r.t)
        assert [r.best for r in own] == list(np.maximum.accumulate([r.score for r in own]))
    prints = q("content_fingerprint")[0]
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    again = formats.fingerprint(orders.orderBy(F.rand(3)), "o_orderkey").first()
    assert (prints.n_rows, prints.digest) == (orders.count(), again.digest)
    assert formats.fingerprint(orders.withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_orderkey").first().digest != again.digest


def test_a_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1024]"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session)


@pytest.mark.parametrize(("n", "lags"), [(0, 2), (1, 3), (5, 8), (500, 1), (500, 40), (37, 36), (300, 0)])
def test_lag_products_cross_parts(spark, n, lags):
    rng = random.Random(n + lags)
    x = [rng.gauss(0, 1) for _ in range(n)]
    rows = [(i * 3, v) for i, v in enumerate(x)]
    rng.shuffle(rows)
    found = order.lag_products(spark.createDataFrame(rows, "k long, v double"), "k", "v", lags).collect()
    if not n:
        assert found == []
        return
    assert found[0].n == n
    assert np.allclose(found[0].sums, [sum(x[i] * x[i - k] for i in range(k, n)) for k in range(lags + 1)])


def test_lag_products_of_small_batches_and_parts(spark):
    x = [float((7 * i) % 11) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(x)), "k long, v double")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    try:
        found = order.lag_products(rows, "k", "v", 7).first()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert np.allclose(found.sums, [sum(x[i] * x[i - k] for i in range(k, 60)) for k in range(8)])
