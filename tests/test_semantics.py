"""Missing values, ties and edges that the queries rely on."""

import math

import pytest
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.functions import distributions as D
from gneiss.operators import collapse, graph, inference, joins, metrics, screening


def test_all_missing_group_sums_to_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (None, 5.0)], "k int, x double")
    got = {r.k: r for r in collapse.summarize(df, "k", "P", ["x"]).collect()}
    assert set(got) == {1, 2} and got[1].P_X_SUM == 0 and got[1].P_X_MEAN is None and got[1].P_COUNT == 2


def test_missing_category_stays_in_the_denominator(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "b")], "k int, c string")
    r = collapse.summarize(df, "k", "P", [], ["c"]).first()
    assert math.isclose(r.P_C_A_MEAN, 1 / 3) and math.isclose(r.P_C_B_MEAN, 1 / 3)


def test_unknown_comparisons_and_zero_denominators(spark):
    r = spark.createDataFrame([(None, 0.0, float("inf"))], "a double, b double, c double").select(
        C.holds(F.col("a") > 0).alias("h"), C.ratio(F.lit(1.0), "b").alias("z"), C.finite("c").alias("f"), C.clip("a", 0, 1).alias("k"), C.without_sentinel(F.lit(365243)).alias("s")
    ).first()
    assert tuple(r) == (0, None, None, None, None)


def test_ties_in_ranking(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double")
    r = metrics.ranking(df).first()
    assert math.isclose(r.auc, 0.875) and math.isclose(r.ap, 0.5 * 1 + 0.5 * 2 / 3)


def test_continuity_correction(spark):
    rows = [(None, 1)] * 30 + [(None, 0)] * 10 + [(1.0, 1)] * 12 + [(1.0, 0)] * 14
    r = screening.missingness(spark.createDataFrame(rows, "x double, y int"), ["x"], "y").first()
    assert math.isclose(r.chi2, 4.4882, abs_tol=1e-3)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert screening.correlations(df, ["a", "b"]).first().r is None


def test_repeated_right_key_is_an_error(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, x int")
    with pytest.raises(Exception, match="repeated k"):
        joins.feature_join(left, right, "k").collect()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_quantile_bins_with_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 0, 0, 1, 2, 3, 4)], "x double")
    assert collapse.quantile_edges(df, "x", 4) == [0, 0.5, 2.25, 4]


def test_holm_and_bh(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    got = {r.name: (round(r.holm, 6), round(r.bh, 6)) for r in inference.adjust_p(df).collect()}
    assert got == {"a": (0.03, 0.03), "b": (0.06, 0.04), "c": (0.06, 0.04)}


def test_distribution_functions():
    assert math.isclose(D.normal_two_sided(1.959964), 0.05, abs_tol=1e-6)
    assert math.isclose(D.chi2_upper(3.841459, 1), 0.05, abs_tol=1e-6)
    assert math.isclose(D.f_upper(4.964603, 1, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(D.t_two_sided(2.228139, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(D.studentized_range_quantile(0.05, 3), 3.314, abs_tol=2e-3)


def test_narrowed_and_without_constant(spark):
    from gneiss.operators import collapse

    df = spark.createDataFrame([(i, i * 1000, 10**12, 0.5 * i, 0.1, None if i else "x", 7) for i in range(100)], "a long, b long, c long, d double, e double, f string, g int")
    assert dict(collapse.narrowed(df).dtypes) == {"a": "tinyint", "b": "int", "c": "bigint", "d": "float", "e": "double", "f": "string", "g": "tinyint"}
    assert collapse.narrowed(df).selectExpr("sum(a)", "sum(b)", "sum(c)", "sum(d)").collect() == df.selectExpr("sum(a)", "sum(b)", "sum(c)", "sum(d)").collect()
    assert collapse.without_constant(df).columns == ["a", "b", "d"]
    assert collapse.without_constant(df.where("false")).columns == df.columns


def test_block_values_combined(spark):
    import math

    from gneiss.operators import inference

    p = [0.01, 0.2, 0.04, None]
    r = inference.combined_p(spark.createDataFrame([(x,) for x in p], "p double")).first()
    x = -2 * sum(math.log(v) for v in p[:3])
    assert abs(r.fisher - x) < 1e-9 and abs(r.fisher_p - math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2)) < 1e-9 and abs(r.holm_least - 0.03) < 1e-12 and r.n == 3
