"""Balancing, learner and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import balance, learners, metrics
from gneiss.operators.splits import impute_median, standardize
from gneiss.plans import frames as P
from gneiss.sources.storage import materialize, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NUMBERS = ["mean_amount", "n_orders", "closed"]


def query(name: str, sql: str | None = None, plain: str = "", doubles: str = "", digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        if sql:
            ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


def _moments(c: str) -> str:
    return f"avg({c}) filter (target = 1) as m1_{c}, var_pop({c}) filter (target = 1) as v1_{c}, avg({c}) filter (target = 0) as m0_{c}, var_pop({c}) filter (target = 0) as v0_{c}, var_pop({c}) as w_{c}"


@query(
    "naive_bayes_scores",
    f"""with {P.FEATURES_SQL}, f as (select ln(count(*) filter (target = 1) / (count(*) filter (target = 0))) as prior, {', '.join(map(_moments, NUMBERS))} from feats where u < 0.8), e as (select *, 1e-9 * greatest({', '.join('w_' + c for c in NUMBERS)}) as x from f)
        select c_custkey, prior + """
    + " + ".join(f"coalesce((-0.5 * ln(v1_{c} + x) - pow({c} - m1_{c}, 2) / (2 * (v1_{c} + x))) - (-0.5 * ln(v0_{c} + x) - pow({c} - m0_{c}, 2) / (2 * (v0_{c} + x))), 0)" for c in NUMBERS)
    + " as s from feats, e where u >= 0.8",
    "c_custkey",
    "s",
)
def naive_bayes_scores(spark, d) -> DataFrame:
    f = P.features(spark, d)
    return learners.naive_bayes(f.where("u < 0.8"), f.where("u >= 0.8"), NUMBERS, "target").select("c_custkey", "s")


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") == 0).cast("int").alias("y"))


@query(
    "knn_scores",
    """with q as (select vec_id as id, embedding as x from embeddings where vec_id % 100 = 0), d as (select id, cast(label = 0 as integer) as y, list_distance(cast(x as double[]), cast(embedding as double[])) as distance, vec_id from q, embeddings where vec_id % 100 <> 0),
       n as (select *, row_number() over (partition by id order by distance, vec_id) as nth from d) select id, sum(y / (distance + 1e-6)) / sum(1 / (distance + 1e-6)) as s from n where nth <= 15 group by id""",
    "id",
    "s",
)
def knn_scores(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    return learners.knn_scores(v.where("id % 100 <> 0"), v.where("id % 100 = 0"), 15, "distance")


_SMOTE = f"""with v as (select vec_id as id, cast(embedding as double[]) as x from embeddings where label = 0), c as (select (select count(*) from v) as n, greatest(0, cast(floor(0.5 * (select count(*) from embeddings where label <> 0)) as bigint) - (select count(*) from v)) as wanted),
    r as (select id, row_number() over (order by {P.uniform_sql('id')}, id) - 1 as nth from v), s as (select id, copy from r, c, range(100) t(copy) where copy * n + nth < wanted),
    d as (select a.id, b.id as point, row_number() over (partition by a.id order by list_distance(a.x, b.x), b.id) as nth from v a, v b where a.id <> b.id), k as (select * from d where nth <= 5),
    p as (select s.id, s.copy, k.point from s join k on k.id = s.id where k.nth = cast(floor({P.uniform_sql('s.id', 's.copy')} * 5) as bigint) + 1)
    select p.id, cast(p.copy as integer) as copy, p.point, list_sum(a.x) + (list_sum(b.x) - list_sum(a.x)) * {P.uniform_sql('p.id', 'p.copy', seed=43)} as total from p join v a on a.id = p.id join v b on b.id = p.point"""


@query("smote", _SMOTE, "id, copy, point", "total", 5)
def smote(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    made = balance.smote(v.where("y = 1"), v.where("y = 0").count())
    return made.select("id", "copy", "point", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("adasyn")
def adasyn(spark, d) -> DataFrame:
    return balance.adasyn(_vectors(spark, d)).select("id", "copy", "point", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"))


def _prepared(spark, d) -> tuple[DataFrame, DataFrame]:
    f = P.features(spark, d)
    filled = impute_median(f.where("u < 0.8"), f, NUMBERS)
    scaled = standardize(filled.where("u < 0.8"), filled, NUMBERS).withColumnRenamed("target", "y")
    scaled = materialize(scaled.select("c_custkey", "y", "u", *NUMBERS), "prepared")  # every fit reads it many times
    return scaled.where("u < 0.8"), scaled.where("u >= 0.8")


@query("learner_metrics")
def learner_metrics(spark, d) -> DataFrame:
    """AUC and average precision on held-out rows of each classifier."""
    train, test = _prepared(spark, d)
    small = {"tree": {"maxDepth": 4}, "forest": {"numTrees": 20, "maxDepth": 5}, "boosting": {"maxIter": 10, "maxDepth": 3}, "logistic_l1": {"regParam": 0.01}, "logistic_l2": {"regParam": 0.01}, "svm": {"regParam": 0.01}}
    out = None
    for name, params in small.items():
        r = metrics.ranking(learners.scores(learners.learner(name, NUMBERS, "y", **params).fit(train), test)).withColumn("model", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@query("regressor_metrics")
def regressor_metrics(spark, d) -> DataFrame:
    train, test = _prepared(spark, d)
    small = {"ridge": {"regParam": 0.1}, "lasso": {"regParam": 0.001}, "tree_regression": {"maxDepth": 4}}
    out = None
    for name, params in small.items():
        r = metrics.regression(learners.scores(learners.learner(name, NUMBERS, "y", **params).fit(train), test)).withColumn("model", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@query("adversarial_auc")
def adversarial_auc(spark, d) -> DataFrame:
    f = P.features(spark, d)
    return learners.adversarial_auc(f.where("u < 0.7"), f.where("u >= 0.7"), NUMBERS, folds=3, maxIter=5, maxDepth=3)
