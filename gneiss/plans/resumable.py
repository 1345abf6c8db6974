"""Fitted transformers, studies of real learners, replicates, rolling windows and stage tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import metrics, modelling, order, replicates, studies, transformer
from gneiss.plans import frames as P
from gneiss.plans.modelling import CANDIDATES, _study_sql
from gneiss.sources.stages import stage
from gneiss.sources.storage import materialize, shared_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NUMERIC, CATEGORICAL = ["mean_amount", "max_amount", "n_orders", "mean_days", "closed"], ["nation"]


def query(name: str, sql: str | None = None, plain: str = "", doubles: str = "", digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        if sql:
            ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


def _customers(spark, d) -> DataFrame:
    """Features with a category that has rare and missing levels."""
    nation = F.when(F.col("c_custkey") % 11 != 0, F.when(F.col("c_custkey") % 97 == 0, F.concat(F.lit("x"), F.col("c_custkey"))).otherwise(F.concat(F.lit("n"), F.col("c_nationkey") % 6)))
    return P.features(spark, d).withColumn("nation", nation)


_NATION = "case when c_custkey % 11 = 0 then 'unknown' when c_custkey % 97 = 0 then 'x' || c_custkey else 'n' || c_nationkey % 6 end"
_STATE = ", ".join(f"coalesce(median({c}), 0) as d_{c}" for c in NUMERIC)
_SCALED = ", ".join(f"(coalesce({c}, d_{c}) - m_{c}) / case when s_{c} > 0 then s_{c} else 1 end as z_{c}" for c in NUMERIC)
_FITTED = f"""with {P.FEATURES_SQL}, named as (select *, {_NATION} as nation from feats), md as (select {_STATE} from named where u < 0.8),
    st as (select {', '.join(f'avg(coalesce({c}, d_{c})) as m_{c}, stddev_pop(coalesce({c}, d_{c})) as s_{c}' for c in NUMERIC)} from named, md where u < 0.8),
    lv as (select nation from named where u < 0.8 group by nation having count(*) >= 20)
    select c_custkey, {_SCALED}, case when lv.nation is null then 'pooled' else lv.nation end as level from named left join lv using (nation), md, st"""


@query("fitted_columns", _FITTED, "c_custkey, level", ", ".join(f"z_{c}" for c in NUMERIC))
def fitted_columns(spark, d) -> DataFrame:
    """Every customer's scaled numbers and the level that is hot, by a transformer fitted on the development rows and read back from its table."""
    rows = _customers(spark, d)
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    transformer.fit(rows.where("u < 0.8"), NUMERIC, CATEGORICAL).write.parquet(path)
    state = transformer.rows_of(spark.read.parquet(path))
    at = {name: i for i, name in enumerate(transformer.names(state))}
    levels = F.array(*(F.lit(r.level) for r in state))
    hot = F.array_compact(F.transform(F.arrays_zip(F.col("features").alias("f"), levels.alias("l")), lambda x: F.when((x["f"] == 1) & x["l"].isNotNull(), x["l"])))
    return transformer.apply(rows, state).select("c_custkey", *(F.get("features", F.lit(at[c])).alias(f"z_{c}") for c in NUMERIC), F.get(hot, F.lit(0)).alias("level"))


@query("refit_equals_cached", f"with {P.FEATURES_SQL} select c_custkey % 3 as fold, count(*) as n, 0 as different from feats group by 1", "fold, n, different")
def refit_equals_cached(spark, d) -> DataFrame:
    """Transformers of three folds fitted in one pass against one fitted on each fold alone: rows whose features differ."""
    rows = _customers(spark, d).withColumn("fold", F.col("c_custkey") % 3)
    spread = rows.drop("fold").withColumn("fold", F.explode(F.array(*map(F.lit, range(3))))).where(F.col("c_custkey") % 3 != F.col("fold"))
    states = transformer.fit(spread, NUMERIC, CATEGORICAL, ["fold"])
    out = None
    for k in range(3):
        cached = transformer.features(transformer.rows_of(states.where(F.col("fold") == k)))
        refit = transformer.features(transformer.rows_of(transformer.fit(rows.where(F.col("fold") != k), NUMERIC, CATEGORICAL)))
        gap = F.exists(F.zip_with(cached, refit, lambda a, b: F.abs(a - b) > 1e-9), lambda x: F.coalesce(x, F.lit(True))) | (F.size(cached) != F.size(refit))
        t = rows.where(F.col("fold") == k).agg(F.count("*").alias("n"), F.sum(gap.cast("int")).alias("different")).select(F.lit(k).alias("fold"), "n", "different")
        out = t if out is None else out.unionByName(t)
    return out


def _study(spark) -> studies.Study:
    fits = {"logistic": studies.estimator("logistic_l2", regParam=0.01), "tree": studies.estimator("tree", maxDepth=4)}
    return studies.Study(f"{shared_dir(spark)}/study-{uuid.uuid4().hex}", "c_custkey", "target", NUMERIC, CATEGORICAL, fits, outer=2, inner=2, at_once=4)


@query("learner_study")
def learner_study(spark, d) -> DataFrame:
    """Two learners over nested folds: the better one of each outer fold, its threshold, outer AUC and optimism."""
    study = _study(spark)
    study.run(materialize(_customers(spark, d), "customers").where("u < 0.8"))
    return study.judged(spark)


@query("learner_final")
def learner_final(spark, d) -> DataFrame:
    """The finalist refitted on the development rows, saved, and evaluated once on the test rows."""
    study, rows = _study(spark), materialize(_customers(spark, d), "customers")  # a join that folds, transformers and scores read many times
    study.run(rows.where("u < 0.8"))
    return study.final(rows.where("u < 0.8"), rows.where("u >= 0.8"))


@query(
    "optimism",
    f"with {_study_sql('true')} select best.k as fold, inner_auc as inner_score, auc as outer_score, inner_auc - auc as optimism from best join au on au.k = best.k and au.candidate = best.candidate and j = -1",
    "fold",
    "inner_score, outer_score, optimism",
)
def optimism(spark, d) -> DataFrame:
    """Inner minus outer score of the candidate that each fold of a nested study chose."""
    t = modelling.nested_study(P.features(spark, d), "c_custkey", "target", CANDIDATES)
    return t.select(F.col("outer_fold").alias("fold"), F.col("inner_auc").alias("inner_score"), F.col("outer_auc").alias("outer_score"), "optimism")


_DRAWN = f"with {P.FEATURES_SQL}, reps as (select unnest(range(20)) as r), drawn as (select c_custkey, target, mean_amount, r, {replicates.weights_sql('c_custkey', 'r')} as w from feats, reps)"


@query(
    "bootstrap_means",
    f"{_DRAWN} select target, cast(r as integer) as replicate, sum(w * mean_amount) / sum(w) as mean from drawn where mean_amount is not null group by target, r",
    "target, replicate",
    "mean",
)
def bootstrap_means(spark, d) -> DataFrame:
    """Mean amount of each class in twenty replicates."""
    return replicates.replicate_means(P.features(spark, d), "mean_amount", replicates.draws("c_custkey", 20), "target")


@query(
    "bootstrap_auc",
    f"""{_DRAWN}, t as (select r, mean_amount as s, sum(w * target) as p, sum(w * (1 - target)) as n from drawn where mean_amount is not null group by 1, 2),
        b as (select *, sum(n) over (partition by r order by s) - n as below from t)
        select cast(r as integer) as replicate, sum(p * (below + n / 2)) / (sum(p) * sum(n)) as auc from b group by r""",
    "replicate",
    "auc",
)
def bootstrap_auc(spark, d) -> DataFrame:
    """AUC of the mean amount over all rows in twenty replicates."""
    rows = P.features(spark, d).withColumnsRenamed({"target": "y", "mean_amount": "s"})
    return replicates.replicate_auc(rows, replicates.draws("c_custkey", 20))


_LINES = f"""lines as (select l_orderkey, l_linenumber, l_quantity as x, ln(l_extendedprice) as y, case when u < 0.64 then 'train' when u < 0.8 then 'validation' else 'test' end as part
    from (select *, {P.uniform_sql('l_orderkey', 'l_linenumber')} as u from lineitem)),
    model as (select regr_slope(y, x) as b, regr_intercept(y, x) as a from lines where part = 'train'),
    fitted as (select l_orderkey, l_linenumber, part, x, y, a + b * x as fitted from lines, model)"""


def _fitted(spark, d) -> DataFrame:
    u = C.uniform("l_orderkey", "l_linenumber")
    part = F.when(u < 0.64, "train").when(u < 0.8, "validation").otherwise("test")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), F.log(F.col("l_extendedprice").cast("double")).alias("y"), part.alias("part"))
    m = lines.where("part = 'train'").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")).first()
    return lines.withColumn("fitted", F.lit(m.a) + F.lit(m.b) * F.col("x"))


@query(
    "three_set_predictions",
    f"""with {_LINES} select l_orderkey, l_linenumber, part, fitted, case when count(y) over w = 2000 then avg(y) over w end as actual_2000, case when count(y) over w = 2000 then avg(fitted) over w end as fitted_2000
        from fitted window w as (partition by part order by x, l_orderkey, l_linenumber, y rows between 1000 preceding and 999 following)""",
    "l_orderkey, l_linenumber, part",
    "fitted, actual_2000, fitted_2000",
    6,
)
def three_set_predictions(spark, d) -> DataFrame:
    """A line through log prices fitted on training rows, its predictions on training, validation and test rows, and centred means of 2,000 rows of each set in the order of the fit."""
    keys = [F.col(c) for c in ("x", "l_orderkey", "l_linenumber", "y")]
    rolled = order.rolling(_fitted(spark, d), keys, {"actual_2000": F.col("y"), "fitted_2000": F.col("fitted")}, 2000, by=["part"])
    return rolled.select("l_orderkey", "l_linenumber", "part", "fitted", "actual_2000", "fitted_2000")


@query(
    "three_set_metrics",
    f"with {_LINES} select part, count(*) as n, sqrt(avg(pow(y - fitted, 2))) as rmse, avg(abs(y - fitted)) as mae, 1 - sum(pow(y - fitted, 2)) / (var_pop(y) * count(*)) as r2 from fitted group by part",
    "part, n",
    "rmse, mae, r2",
    6,
)
def three_set_metrics(spark, d) -> DataFrame:
    """Errors of the same fit on each set."""
    rows, gap = _fitted(spark, d), F.col("y") - F.col("fitted")
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), (1 - F.sum(gap * gap) / (F.var_pop("y") * F.count("*"))).alias("r2"))


@query(
    "rolling_over_table",
    "select o_orderkey, case when count(o_totalprice) over w >= 500 then avg(o_totalprice) over w end as mean_1001 from orders window w as (order by o_orderdate, o_orderkey rows between 500 preceding and 500 following)",
    "o_orderkey",
    "mean_1001",
    4,
)
def rolling_over_table(spark, d) -> DataFrame:
    """Centred mean of 1,001 orders in order of date over the whole table, of 500 at least at the ends."""
    keys = [F.col("o_orderdate"), F.col("o_orderkey")]
    return order.rolling(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), keys, {"mean_1001": F.col("o_totalprice")}, 1001, 500).select("o_orderkey", "mean_1001")


@query(
    "staged_summary",
    "select attempt, o_orderpriority as priority, count(*) as n, sum(o_totalprice) as total, attempt in (0, 2) as built from orders, (select unnest([0, 1, 2]) as attempt) where attempt < 2 or o_orderkey % 2 = 0 group by all",
    "attempt, priority, n, built",
    "total",
    3,
)
def staged_summary(spark, d) -> DataFrame:
    """A stage table asked for three times: built, found again for the same rows in another order, built anew for other rows."""
    folder, orders, calls = f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}", table(spark, d, "orders"), []
    out = None
    for attempt, rows in enumerate((orders, orders.repartition(5), orders.where("o_orderkey % 2 = 0"))):
        before = len(calls)

        def make(rows: DataFrame = rows) -> DataFrame:
            calls.append(1)
            return rows.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("total"))

        found = stage(folder, "summary", [rows], make)
        # stages replace each other in their folder, so each is taken along before the next
        kept = spark.createDataFrame(found.collect(), found.schema).withColumns({"attempt": F.lit(attempt), "built": F.lit(len(calls) > before)})  # a row for each priority
        out = kept if out is None else out.unionByName(kept)
    return out


@query("replicate_interval")
def replicate_interval(spark, d) -> DataFrame:
    """AUC of a score over all rows with its BCa interval from replicates and a grouped jackknife, beside DeLong's."""
    rows = P.features(spark, d).withColumnsRenamed({"target": "y", "mean_amount": "s"})
    point, low, high = replicates.auc_interval(rows, "c_custkey", 400, 50)
    delong = modelling.delong_interval(rows, "s").select(F.col("low").alias("delong_low"), F.col("high").alias("delong_high"))
    exact = metrics.ranking(rows.select("y", "s")).select("auc")
    return exact.crossJoin(spark.createDataFrame([(point, low, high)], "replicate_0 double, low double, high double")).crossJoin(delong)  # one row each
