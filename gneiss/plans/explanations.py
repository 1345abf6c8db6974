"""Contributions of columns to the scores of fitted models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import contributions, importance, learners, splits
from gneiss.plans import frames as P
from gneiss.plans.learning import NUMBERS, _prepared
from gneiss.plans.modelling import _stats_sql
from gneiss.sources.storage import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TREES = {"boosting": {"maxIter": 8, "maxDepth": 4}, "forest": {"numTrees": 15, "maxDepth": 5}}


def query(name: str, sql: str | None = None, plain: str = "", doubles: str = "", digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        if sql:
            ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


def _explained(spark, d) -> DataFrame:
    train, test = _prepared(spark, d)
    out = []
    for name, params in TREES.items():
        model = learners.learner(name, NUMBERS, "y", **params).fit(train)
        out.append(contributions.tree_contributions(model, test.select("c_custkey", *NUMBERS), NUMBERS).withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


@query("tree_contributions")
def tree_contributions(spark, d) -> DataFrame:
    """Effect of each column on the margin of every test row, for a forest and a boosted model."""
    named = F.explode(F.arrays_zip(F.array(*map(F.lit, NUMBERS)).alias("feature"), F.col("effects").alias("effect"))).alias("x")
    return _explained(spark, d).select("c_custkey", "model", "margin", "base", named).select("c_custkey", "model", "margin", "base", "x.feature", "x.effect")


@query("tree_importance")
def tree_importance(spark, d) -> DataFrame:
    """Mean absolute effect of each column, and the largest gap between a margin and its parts."""
    rows = _explained(spark, d)
    gap = F.abs(F.col("margin") - F.col("base") - F.aggregate("effects", F.lit(0.0), lambda s, x: s + x))
    gaps = rows.groupBy("model").agg(F.max(gap).alias("gap"))
    effects = rows.select("model", F.explode(F.arrays_zip(F.array(*map(F.lit, NUMBERS)).alias("feature"), F.col("effects").alias("effect"))).alias("x"))
    return effects.groupBy("model", F.col("x.feature").alias("feature")).agg(F.avg(F.abs("x.effect")).alias("mean_abs")).join(gaps, "model")


@query("model_contributions")
def model_contributions(spark, d) -> DataFrame:
    """Effects of any model (here a boosted one, by its scores alone) on every test row, against 25 centres of the training rows."""
    train, test = _prepared(spark, d)
    model = learners.learner("boosting", NUMBERS, "y", **TREES["boosting"]).fit(train)
    around = contributions.background(train, NUMBERS)
    return contributions.model_contributions(test, "c_custkey", NUMBERS, around, lambda rows: learners.scores(model, rows))


_TERM = {c: f"((-0.5 * ln(v1_{c} + x) - pow({{0}} - m1_{c}, 2) / (2 * (v1_{c} + x))) - (-0.5 * ln(v0_{c} + x) - pow({{0}} - m0_{c}, 2) / (2 * (v0_{c} + x))))" for c in NUMBERS}
_ADDITIVE = f"""with {P.FEATURES_SQL}, md as (select {', '.join(f'median({c}) as d_{c}' for c in NUMBERS)} from feats where u < 0.8),
    filled as (select c_custkey, target, c_nationkey, u, {', '.join(f'coalesce({c}, d_{c}) as {c}' for c in NUMBERS)} from feats, md),
    st as (select {_stats_sql('target')} from filled where u < 0.8), e as (select *, 1e-9 * greatest({', '.join('w_' + c for c in NUMBERS)}) as x from st),
    around as (select {', '.join(f'avg({c}) as {c}' for c in NUMBERS)}, count(*) / sum(count(*)) over () as weight from filled where u < 0.8 group by c_nationkey),
    mean as (select {', '.join(f"sum(weight * {_TERM[c].format(c)}) as t_{c}" for c in NUMBERS)} from around, e),
    each as (select c_custkey, {', '.join(f"{_TERM[c].format(c)} as t_{c}" for c in NUMBERS)} from filled, e where u >= 0.8)
    {' union all '.join(f"select c_custkey, '{c}' as feature, each.t_{c} - mean.t_{c} as effect from each, mean" for c in NUMBERS)}"""


@query("additive_contributions", _ADDITIVE, "c_custkey, feature", "effect", 5)
def additive_contributions(spark, d) -> DataFrame:
    """The same for naive Bayes, whose score is a sum over columns: each effect is the column's part less its mean over the background (mean rows of nations)."""
    f = splits.impute_median(P.features(spark, d).where("u < 0.8"), P.features(spark, d), NUMBERS)
    train, test = f.where("u < 0.8"), f.where("u >= 0.8")
    sizes = train.groupBy("c_nationkey").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in NUMBERS))
    around = sizes.crossJoin(sizes.agg(F.sum("n").alias("all_n"))).select(*NUMBERS, (F.col("n") / F.col("all_n")).alias("weight"))
    predict = lambda rows: learners.naive_bayes(train, rows, NUMBERS, "target")
    return contributions.model_contributions(test, "c_custkey", NUMBERS, around, predict).select("c_custkey", "feature", "effect")


@query("parameter_importance")
def parameter_importance(spark, d) -> DataFrame:
    """Variance shares of quantity, discount and tax, and of their pairs, in a forest of line prices."""
    lines = table(spark, d, "lineitem").select(*(F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax")), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("score"))
    names = ["quantity", "discount", "tax"]
    r = lines.agg(*(f(c).alias(f"{n}_{c}") for c in names for n, f in (("low", F.min), ("high", F.max)))).first()
    shares = importance.variance_shares(importance.forest_of_runs(lines, names, "score", trees=10, depth=6), {c: (r[f"low_{c}"], r[f"high_{c}"]) for c in names})
    return spark.createDataFrame([(" x ".join(own), float(v)) for own, v in shares.items()], "parameters string, share double")


_GRID = [i / 10 for i in range(11)]


@query(
    "density_ratio",
    f"""with r as (select l_discount * 10 as x, l_extendedprice as score from lineitem), q as (select quantile_cont(score, 0.75) as lim from r), g as (select x, score >= lim as good from r, q),
        w as (select good, count(*) as n, case when stddev_pop(x) > 0 then stddev_pop(x) * pow(count(*), -0.2) else 1 end as h from g group by good),
        k as (select t.p as pos, good, sum(exp(-pow((t.p - x) / h, 2) / 2) / (h * sqrt(2 * pi()) * n)) as dens from g join w using (good), (select unnest({_GRID}) as p) t group by 1, 2)
        select a.pos as point, a.dens as density_good, b.dens as density_rest, a.dens / b.dens as ratio from k a join k b on a.pos = b.pos and a.good and not b.good""",
    "",
    "point, density_good, density_rest, ratio",
    5,
)
def density_ratio(spark, d) -> DataFrame:
    """Densities of the discount among the dearest quarter of lines and the others, and their ratio."""
    lines = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("x"), F.col("l_extendedprice").alias("score"))
    return importance.density_ratio(lines, "x", "score", _GRID).withColumnRenamed("at", "point")
