"""Run logs, selection of finalists, curves and remaining tables, with their SQL twins.

The run log is the event stream: a user is a unit, its events in order are the
evaluations, ``value`` the score, ``event_type`` the search method.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import collapse, inference, order, quantiles, replicates, screening
from gneiss.plans import frames as P
from gneiss.sources.storage import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: str = "", doubles: str = "", digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        if sql:
            ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


RUNS_SQL = "runs as (select user_id as unit, event_type as method, user_id % 5 as fold, row_number() over (partition by user_id order by ts, event_id) as t, value as score, ts, event_id from events)"


def runs(spark, d) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("unit"), F.col("event_type").alias("method"), (F.col("user_id") % 5).alias("fold"), F.row_number().over(order).cast("long").alias("t"), F.col("value").alias("score"), "ts", "event_id"
    )


@query(
    "unit_enumeration",
    """select concat_ws('__', task, model, balancing, optimizer, cast(fold as varchar)) as unit_key, task, model, balancing, optimizer, fold from
       (select 'class' as task, unnest(['knn','nb','log','tree','rf','xgb','svm']) as model) m, (select unnest(['none','weight','smote','adasyn']) as balancing) b, (select unnest(['grid','random','bayes','genetic']) as optimizer) o, (select unnest(range(5)) as fold) f
       union all select concat_ws('__', task, model, balancing, optimizer, cast(fold as varchar)), task, model, balancing, optimizer, fold from
       (select 'reg' as task, unnest(['knn','ridge','lasso','tree','rf','xgb','svr']) as model) m, (select 'none' as balancing) b, (select unnest(['grid','random','bayes','genetic']) as optimizer) o, (select unnest(range(5)) as fold) f""",
    "unit_key, task, model, balancing, optimizer, fold",
)
def unit_enumeration(spark, d) -> DataFrame:
    """All units of work: a cross product of four short lists for each task (700 rows)."""

    def product(task: str, models: str, balancing: str) -> DataFrame:
        lists = {"model": models.split(), "balancing": balancing.split(), "optimizer": "grid random bayes genetic".split()}
        out = spark.range(5).select(F.lit(task).alias("task"), F.col("id").alias("fold"))
        for name, values in lists.items():
            out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
        return out

    both = product("class", "knn nb log tree rf xgb svm", "none weight smote adasyn").unionByName(product("reg", "knn ridge lasso tree rf xgb svr", "none"))
    return both.select(F.concat_ws("__", "task", "model", "balancing", "optimizer", F.col("fold").cast("string")).alias("unit_key"), "task", "model", "balancing", "optimizer", "fold")


@query(
    "anytime_curves",
    f"""with {RUNS_SQL}, b as (select *, max(score) over (partition by unit order by t) as best, max(score) over (partition by fold) as known from runs) select unit, t, best, known - best as gap from b""",
    "unit, t",
    "best, gap",
)
def anytime_curves(spark, d) -> DataFrame:
    r = runs(spark, d).withColumn("best", F.max("score").over(Window.partitionBy("unit").orderBy("t"))).withColumn("known", F.max("score").over(Window.partitionBy("fold")))
    return r.select("unit", "t", "best", (F.col("known") - F.col("best")).alias("gap"))


@query(
    "evaluations_to_target",
    f"""with {RUNS_SQL}, b as (select *, max(score) over (partition by unit order by t) as best, max(score) over (partition by fold) as known from runs)
        select unit, coalesce(min(case when best >= 0.5 * known then t end), 21) as first_t, avg(known - best) as gap_area, max(case when t = 20 then known - best end) as final_gap from b where t <= 20 group by unit""",
    "unit, first_t",
    "gap_area, final_gap",
)
def evaluations_to_target(spark, d) -> DataFrame:
    """First evaluation within half of the best known score (21: never), mean and final gap over 20."""
    r = runs(spark, d).withColumn("best", F.max("score").over(Window.partitionBy("unit").orderBy("t"))).withColumn("known", F.max("score").over(Window.partitionBy("fold")))
    gap = F.col("known") - F.col("best")
    return r.where("t <= 20").groupBy("unit").agg(F.coalesce(F.min(F.when(F.col("best") >= 0.5 * F.col("known"), F.col("t"))), F.lit(21)).alias("first_t"), F.avg(gap).alias("gap_area"), F.max(F.when(F.col("t") == 20, gap)).alias("final_gap"))


@query(
    "filled_curve",
    f"""with {RUNS_SQL}, n as (select unit, unnest(range(1, (select max(t) + 1 from runs))) as t from (select distinct unit from runs)), j as (select n.unit, n.t, score from n left join runs r on r.unit = n.unit and r.t = n.t)
        select unit, t, last_value(score ignore nulls) over (partition by unit order by t rows unbounded preceding) as score from j""",
    "unit, t",
    "score",
)
def filled_curve(spark, d) -> DataFrame:
    """Each unit's scores carried forward to the longest unit's number of evaluations."""
    r = runs(spark, d).select("unit", "t", "score")
    grid = r.select("unit").distinct().crossJoin(r.agg(F.max("t").alias("most"))).select("unit", F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias("t"))
    w = Window.partitionBy("unit").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(r, ["unit", "t"], "left").select("unit", "t", F.last("score", ignorenulls=True).over(w).alias("score"))


@query(
    "master_table",
    f"""with {RUNS_SQL} select method, fold, count(*) as n, avg(score) as mean_score, stddev_samp(score) as sd_score, sum(score) / 3600 as hours, quantile_cont(score, 0.95) as p95, arg_min(score, event_id) as first_score from runs group by method, fold""",
    "method, fold, n",
    "mean_score, sd_score, hours, p95, first_score",
)
def master_table(spark, d) -> DataFrame:
    s = F.col("score")
    return runs(spark, d).groupBy("method", "fold").agg(
        F.count("*").alias("n"), F.avg(s).alias("mean_score"), F.stddev(s).alias("sd_score"), (F.sum(s) / 3600).alias("hours"), F.percentile(s, F.lit(0.95)).alias("p95"), F.min_by("score", "event_id").alias("first_score")
    )


@query("pivot_means", "select fold, " + ", ".join(f"avg(value) filter (event_type = '{v}') as {v}" for v in ("click", "view", "purchase")) + " from (select *, user_id % 5 as fold from events) group by fold", "fold", "click, view, purchase")
def pivot_means(spark, d) -> DataFrame:
    wide = runs(spark, d).groupBy("fold").pivot("method", ["click", "view", "purchase"]).agg(F.avg("score"))
    return wide.select("fold", "click", "view", "purchase")


@query(
    "params_by_fold",
    f"with {RUNS_SQL} select method, '[' || string_agg(cast(t as varchar), ',' order by event_id) || ']' as params from runs where unit = (select min(unit) from runs) group by method",
    "method, params",
)
def params_by_fold(spark, d) -> DataFrame:
    r = runs(spark, d)
    first = r.agg(F.min("unit").alias("unit"))
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda x: x["t"].cast("string")))
    return r.join(first, "unit").groupBy("method").agg(F.concat(F.lit("["), text, F.lit("]")).alias("params"))


@query(
    "finalists",
    f"""with {RUNS_SQL}, c as (select method, unit, count(*) as n, avg(score) as mean_score from runs group by method, unit), k as (select * from c where n >= 3)
        select method, unit, mean_score from (select *, row_number() over (partition by method order by mean_score desc, unit) as nth from k) where nth = 1""",
    "method, unit",
    "mean_score",
)
def finalists(spark, d) -> DataFrame:
    """The best complete unit of each method."""
    c = runs(spark, d).groupBy("method", "unit").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).where("n >= 3")
    return collapse.row_at_extreme(c, ["method"], F.col("mean_score"), "unit").select("method", "unit", "mean_score")


@query(
    "final_parameters",
    f"with {RUNS_SQL} select method, arg_max(unit, struct_pack(s := score, e := event_id)) as best_unit, quantile_cont(score, 0.5) as threshold from runs group by method",
    "method, best_unit",
    "threshold",
)
def final_parameters(spark, d) -> DataFrame:
    return runs(spark, d).groupBy("method").agg(F.max_by("unit", F.struct("score", "event_id")).alias("best_unit"), F.percentile("score", F.lit(0.5)).alias("threshold"))


@query(
    "work_gaps",
    f"""with {RUNS_SQL}, g as (select unit, t, (epoch(lead(ts) over (partition by unit order by t)) - epoch(ts)) / 3600 as hours from runs) select unit, count(*) filter (hours > 12) as long_gaps, max(hours) as longest, sum(hours) as span from g group by unit""",
    "unit, long_gaps",
    "longest, span",
    4,
)
def work_gaps(spark, d) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    g = runs(spark, d).withColumn("hours", (F.lead(at).over(Window.partitionBy("unit").orderBy("t")) - at) / 3600)
    return g.groupBy("unit").agg(F.count(F.when(F.col("hours") > 12, 1)).alias("long_gaps"), F.max("hours").alias("longest"), F.sum("hours").alias("span"))


@query(
    "failure_causes",
    f"""with {P.LOG_SQL}, e as (select unit, method, regexp_extract(entry, '(?m)^(\\w+Error: .*)$', 1) as error from log)
        select case when error like '%Timeout%' then 'time' when error like '%allocate%' or error like '%Memory%' then 'memory' when error like '%NaN%' then 'missing values' when error like '%converge%' then 'convergence' else 'other' end as cause,
        method, unit % 5 as fold, count(*) as n, case when error like '%Timeout%' or error like '%allocate%' then 'again with fewer rows at once' when error like '%converge%' then 'more steps' else 'by hand' end as repair
        from e where error <> '' group by all""",
    "cause, method, fold, n, repair",
)
def failure_causes(spark, d) -> DataFrame:
    """Errors of the log by cause, method and fold, with what is done about each."""
    e = P.log(spark, d).select("unit", "method", F.regexp_extract("entry", r"(?m)^(\w+Error: .*)$", 1).alias("error")).where("error <> ''")
    has = lambda *words: reduce(lambda a, b: a | b, (F.col("error").contains(w) for w in words))
    cause = F.when(has("Timeout"), "time").when(has("allocate", "Memory"), "memory").when(has("NaN"), "missing values").when(has("converge"), "convergence").otherwise("other")
    repair = F.when(has("Timeout", "allocate"), "again with fewer rows at once").when(has("converge"), "more steps").otherwise("by hand")
    return e.groupBy(cause.alias("cause"), "method", (F.col("unit") % 5).alias("fold"), repair.alias("repair")).agg(F.count("*").alias("n"))


@query(
    "paired_effects",
    f"""with {RUNS_SQL}, c as (select unit, fold, method, avg(score) as s from runs where method in ('click', 'view') group by unit, fold, method)
        select a.fold, count(*) as n, avg(a.s - b.s) as effect, stddev_samp(a.s - b.s) as sd from c a join c b on a.unit = b.unit and a.method = 'click' and b.method = 'view' group by a.fold""",
    "fold, n",
    "effect, sd",
)
def paired_effects(spark, d) -> DataFrame:
    c = runs(spark, d).groupBy("unit", "fold", "method").agg(F.avg("score").alias("s"))
    a, b = c.where("method = 'click'"), c.where("method = 'view'").select("unit", F.col("s").alias("other"))
    gap = F.col("s") - F.col("other")
    return a.join(b, "unit").groupBy("fold").agg(F.count("*").alias("n"), F.avg(gap).alias("effect"), F.stddev(gap).alias("sd"))


@query(
    "block_auc",
    f"""with {P.SCORES_SQL}, o as (select *, fold * 10 + (row_number() over (partition by fold, y order by {P.order_sql('row')}, row) - 1) % 10 as block from scored),
        r as (select *, rank() over (partition by block order by s) + (count(*) over (partition by block, s) - 1) / 2.0 as rk from o) select block, count(*) as n, (sum(y * rk) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) as auc from r group by block""",
    "block, n",
    "auc",
)
def block_auc(spark, d) -> DataFrame:
    """AUC of ten stratified blocks in each fold."""
    from gneiss.operators.metrics import ranking

    place = F.row_number().over(Window.partitionBy("fold", "y").orderBy(C.hash_order("row"), "row")) - 1
    return ranking(P.scores(spark, d).withColumn("block", F.col("fold") * 10 + place % 10), "block").select(F.col("block").cast("long").alias("block"), "n", "auc")


@query(
    "rank_cliques",
    f"""with {P.BLOCKS_SQL}, r as (select *, rank() over (partition by block order by score desc) + (count(*) over (partition by block, score) - 1) / 2.0 as rk from blocks), m as (select model, avg(rk) as r from r group by model),
        o as (select model, r, row_number() over (order by r, model) as i from m), e as (select a.model, a.r, a.i, max(b.i) as last from o a join o b on b.r between a.r and a.r + 0.9 group by a.model, a.r, a.i)
        select model, r as mean_rank, i as first_place, last as last_place, coalesce(last > max(last) over (order by i rows between unbounded preceding and 1 preceding), true) as maximal from e""",
    "model, first_place, last_place, maximal",
    "mean_rank",
)
def rank_cliques(spark, d) -> DataFrame:
    """Runs of models whose mean ranks are within a critical difference of 0.9; maximal runs are marked."""
    m = inference.average_ranks(P.blocks(spark, d), ["block"], "score", True).groupBy("model").agg(F.avg("rank_avg").alias("r"))
    o = m.withColumn("i", F.row_number().over(Window.orderBy("r", "model")).cast("long"))
    other = o.select(F.col("r").alias("r2"), F.col("i").alias("i2"))
    e = o.join(other, (F.col("r2") >= F.col("r")) & (F.col("r2") <= F.col("r") + 0.9)).groupBy("model", "r", "i").agg(F.max("i2").alias("last"))
    before = F.max("last").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return e.select("model", F.col("r").alias("mean_rank"), F.col("i").alias("first_place"), F.col("last").alias("last_place"), F.coalesce(F.col("last") > before, F.lit(True)).alias("maximal"))


@query(
    "decile_lift",
    f"""with {P.FEATURES_SQL}, e as (select quantile_cont(mean_amount, [{', '.join(str(i / 10) for i in range(11))}]) as q from feats), b as (select target, case {' '.join(f'when mean_amount <= q[{i + 2}] then {i}' for i in range(9))} else 9 end as bin from feats, e where mean_amount is not null)
        select bin, count(*) as n, avg(target) as rate, avg(target) / (select avg(target) from b) as lift from b group by bin""",
    "bin, n",
    "rate, lift",
)
def decile_lift(spark, d) -> DataFrame:
    """Clients, rate and lift of each tenth of the mean amount."""
    f = P.features(spark, d).where("mean_amount is not null")
    b = f.select("target", collapse.bucket(F.col("mean_amount"), collapse.quantile_edges(f, "mean_amount", 10)).alias("bin"))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("target").alias("rate")).crossJoin(b.agg(F.avg("target").alias("whole"))).select("bin", "n", "rate", (F.col("rate") / F.col("whole")).alias("lift"))


@query(
    "source_coverage",
    f"""with {P.TARGET_SQL}, e as (select distinct user_id from events), t as (select target, user_id is not null as has from clients left join e on user_id = c_custkey)
        select 'events' as source, count(*) filter (has) as covered, avg(target) filter (has) as rate_with, avg(target) filter (not has) as rate_without, avg(target) filter (has) - avg(target) filter (not has) as difference from t""",
    "source, covered",
    "rate_with, rate_without, difference",
)
def source_coverage(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    t = P.clients(spark, d).join(e, "c_custkey", "left").withColumn("has", F.coalesce("has", F.lit(False)))
    a, b = F.avg(F.when(F.col("has"), F.col("target"))), F.avg(F.when(~F.col("has"), F.col("target")))
    return t.agg(F.count(F.when(F.col("has"), 1)).alias("covered"), a.alias("rate_with"), b.alias("rate_without"), (a - b).alias("difference")).select(F.lit("events").alias("source"), "*")


@query(
    "recent_against_all",
    f"""with {P.TARGET_SQL}, {P.HISTORY_SQL}, a as (select o_custkey as c_custkey, avg(amount) as all_mean, avg(amount) filter (days >= -365) as year_mean, count(*) as all_n, cast(count(*) filter (days >= -365) as double) as year_n from history group by o_custkey),
        j as (select * from clients join a using (c_custkey)) select 'mean' as variable, abs(corr(all_mean, target)) as all_r, abs(corr(year_mean, target)) as year_r, abs(corr(year_mean, target)) > abs(corr(all_mean, target)) as recent_wins from j
        union all select 'n', abs(corr(all_n, target)), abs(corr(year_n, target)), abs(corr(year_n, target)) > abs(corr(all_n, target)) from j""",
    "variable, recent_wins",
    "all_r, year_r",
)
def recent_against_all(spark, d) -> DataFrame:
    """Is a one-year window of the history closer to the target than the whole?"""
    recent = F.col("days") >= -365
    a = P.history(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.avg("amount").alias("all_mean"), F.avg(F.when(recent, F.col("amount"))).alias("year_mean"), F.count("*").alias("all_n"), F.count(F.when(recent, 1)).alias("year_n")
    )
    j = P.clients(spark, d).join(a, "c_custkey").select("target", "all_mean", "year_mean", "all_n", "year_n")
    r = screening.auc_by_variable(j, ["all_mean", "year_mean", "all_n", "year_n"], "target", 1).select("variable", F.abs("corr").alias("r"))
    name, side = F.substring_index("variable", "_", -1), F.substring_index("variable", "_", 1)
    t = r.groupBy(name.alias("variable")).agg(F.max(F.when(side == "all", F.col("r"))).alias("all_r"), F.max(F.when(side == "year", F.col("r"))).alias("year_r"))
    return t.withColumn("recent_wins", F.col("year_r") > F.col("all_r"))


@query(
    "linear_contributions",
    f"""with {P.FEATURES_SQL}, m as (select avg(mean_amount) as a, avg(n_orders) as b from feats) select 'mean_amount' as variable, avg(abs(2e-6 * (mean_amount - a))) as importance from feats, m union all select 'n_orders', avg(abs(-0.1 * (n_orders - b))) from feats, m""",
    "variable",
    "importance",
)
def linear_contributions(spark, d) -> DataFrame:
    """Mean absolute contribution coef * (x - mean) of each variable of a linear score."""
    coef = {"mean_amount": 2e-6, "n_orders": -0.1}
    long = screening.long_form(P.features(spark, d), list(coef)).withColumn("centre", F.avg("value").over(Window.partitionBy("variable")))
    w = F.create_map(*(x for k, v in coef.items() for x in (F.lit(k), F.lit(v))))
    return long.groupBy("variable").agg(F.avg(F.abs(w[F.col("variable")] * (F.col("value") - F.col("centre")))).alias("importance"))


@query("model_pairs", f"with {P.BLOCKS_SQL}, m as (select distinct model from blocks) select a.model as a, b.model as b from m a join m b on a.model < b.model", "a, b")
def model_pairs(spark, d) -> DataFrame:
    m = P.blocks(spark, d).select("model").distinct()
    return m.select(F.col("model").alias("a")).join(m.select(F.col("model").alias("b")), F.col("a") < F.col("b"))


@query("progress", f"with {RUNS_SQL} select method, count(*) as total, count(*) filter (score > 10) as done, count(*) filter (score <= 10) as failed from runs group by method", "method, total, done, failed")
def progress(spark, d) -> DataFrame:
    return runs(spark, d).groupBy("method").agg(F.count("*").alias("total"), F.count_if(F.col("score") > 10).alias("done"), F.count_if(F.col("score") <= 10).alias("failed"))


@query("block_means", f"with {P.ERRORS_SQL}, r as (select *, row_number() over (order by row) - 1 as pos from errors) select cast(floor(pos / 500) as bigint) as block, count(*) as n, avg(e1 * e1) as loss from r group by 1", "block, n", "loss")
def block_means(spark, d) -> DataFrame:
    return order.positions(P.errors(spark, d), F.col("row")).withColumn("block", F.floor(F.col("pos") / 500)).groupBy("block").agg(F.count("*").alias("n"), F.avg(F.col("e1") * F.col("e1")).alias("loss"))


@query("left_unmatched", "select count(*) as unmatched from orders left join (select distinct l_orderkey from lineitem) on l_orderkey = o_orderkey where l_orderkey is null", "unmatched")
def left_unmatched(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left_anti").agg(F.count("*").alias("unmatched"))


@query("quantile_trim", "select count(*) as n, max(o_totalprice) as top from orders where o_totalprice <= (select quantile_cont(o_totalprice, 0.99) from orders)", "n", "top")
def quantile_trim(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_totalprice")
    return o.crossJoin(quantiles.wide(o, "o_totalprice", {"limit": 0.99})).where("o_totalprice <= limit").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query(
    "white_test",
    f"""with {P.ERRORS_SQL}, v as (select e1 * e1 as y, y as a, y * y as b from errors), t as (select count(*) as n, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as by_, var_pop(y) as yy from v)
        select n, n * ((ay * ay * bb - 2 * ay * by_ * ab + by_ * by_ * aa) / (aa * bb - ab * ab)) / yy as lm from t""",
    "n",
    "lm",
)
def white_test(spark, d) -> DataFrame:
    from gneiss.operators.resampling import white_test as white

    return white(P.errors(spark, d).select(F.col("e1").alias("e"), F.col("y").alias("f")))


@query("nemenyi")
def nemenyi(spark, d) -> DataFrame:
    from gneiss.operators.resampling import nemenyi_p

    return spark.createDataFrame([(a, b, float(p)) for a, b, p in nemenyi_p(P.blocks(spark, d))], "a string, b string, p double")


@query("confidence_set")
def confidence_set(spark, d) -> DataFrame:
    """Model confidence set over block means of two models' squared errors."""
    from gneiss.operators import resampling

    e = P.errors(spark, d).select("row", (F.col("e1") * F.col("e1")).alias("a"), (F.col("e2") * F.col("e2")).alias("b"))
    found = resampling.confidence_set(resampling.block_series(e, ["a", "b"], 100), ["a", "b"])
    return spark.createDataFrame([(model, p, kept) for model, (p, kept) in found.items()], "model string, p double, in_set boolean")


@query("reality_check")
def reality_check(spark, d) -> DataFrame:
    """Whether a model of squared errors beats another: the three studentised p-values, the reality check, and the models that the stepwise test finds better."""
    from gneiss.operators import resampling

    e = P.errors(spark, d).select("row", (F.col("e1") * F.col("e1")).alias("a"), (F.col("e2") * F.col("e2")).alias("b"))
    m = resampling.block_series(e, ["a", "b"], 100)
    found = resampling.reality_check(m[:, 1], m[:, :1], names=["a"])
    return spark.createDataFrame([(k, v, ", ".join(found["names"])) for k, v in found.items() if k != "names"], "test string, p double, better string")


@query("auc_interval")
def auc_interval(spark, d) -> DataFrame:
    """BCa interval of the AUC over all rows, from replicates and a grouped jackknife."""
    point, low, high = replicates.auc_interval(P.scores(spark, d), "row", 500, 100)
    return spark.createDataFrame([(point, low, high)], "auc double, low double, high double")


@query("search_history")
def search_history(spark, d) -> DataFrame:
    """Four searches of a regularised logistic model's penalty, four evaluations each."""
    from gneiss.operators import learners, metrics, search
    from gneiss.plans.learning import NUMBERS, _prepared

    train, test = (x.persist() for x in _prepared(spark, d))
    space = search.Space({"regParam": search.Real(1e-4, 1e-1, log=True)})

    def auc(p) -> float:
        model = learners.learner("logistic_l2", NUMBERS, "y", maxIter=10, **p).fit(train)
        return metrics.ranking(learners.scores(model, test)).first().auc

    try:
        rows = [(m, h["t"], float(h["score"]), float(h["best"]), float(h["params"]["regParam"])) for m in search.METHODS for h in search.search(m, space, auc, 4).history]
    finally:
        train.unpersist()
        test.unpersist()
    return spark.createDataFrame(rows, "method string, t int, score double, best double, reg_param double")
