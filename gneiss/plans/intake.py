"""Source, sink and typing queries with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import collapse, order, screening
from gneiss.plans import frames as P
from gneiss.sources import formats
from gneiss.sources.storage import shared_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: str = "", doubles: str = "", digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        if sql:
            ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


def _scratch(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("csv_scan", "select p_partkey, p_brand, p_size, p_retailprice from part", "p_partkey, p_brand, p_size", "p_retailprice")
def csv_scan(spark, d) -> DataFrame:
    path = _scratch(spark, "csv")
    formats.write_csv(table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), path)
    return formats.read_csv(spark, path, "p_partkey long, p_brand string, p_size int, p_retailprice double")


@query(
    "run_documents",
    "select cast(user_id as varchar) as unit, event_type as model, cast(user_id % 5 as integer) as fold, cast(row_number() over (partition by user_id order by event_id) as integer) as t, value as score from events",
    "unit, model, fold, t",
    "score",
)
def run_documents(spark, d) -> DataFrame:
    """Runs written as JSON documents, read with their schema and exploded."""
    e = table(spark, d, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = e.select(F.col("user_id").cast("string").alias("unit"), F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("fold"), F.struct(t.alias("t"), F.col("value").alias("score")).alias("h"))
    path = _scratch(spark, "runs")
    formats.append_runs(rows.groupBy("unit", "model", "fold").agg(F.array_sort(F.collect_list("h")).alias("history")), path)
    return formats.explode_history(formats.read_runs(spark, path)).select("unit", "model", "fold", "t", "score")


@query("pending_units", "select distinct cast(user_id as varchar) as unit from events where user_id not in (select user_id from events where value > 90)", "unit")
def pending_units(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("unit", F.col("user_id").cast("string"))
    return formats.pending(e.select("unit").distinct(), e.where("value > 90"))


@query("hand_over", "select o_orderkey, o_totalprice, o_orderstatus, case when o_orderkey % 5 = 0 then 'test' else 'dev' end as side from orders", "o_orderkey, o_orderstatus, side", "o_totalprice")
def hand_over(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = _scratch(spark, "hand_over")
    formats.hand_over(o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 5 = 0"), path, "o_orderstatus", [])
    dev, test, roles = formats.take_over(spark, path)
    assert roles["numeric"] == ["o_orderkey", "o_totalprice"]
    return dev.withColumn("side", F.lit("dev")).unionByName(test.withColumn("side", F.lit("test")))


@query("content_fingerprint")
def content_fingerprint(spark, d) -> DataFrame:
    return formats.fingerprint(table(spark, d, "orders"), "o_orderkey")


@query(
    "synthetic_rows",
    f"""with r as (select range as row_id from range(2000)), x as (select row_id, 'g' || cast(cast(floor({P.uniform_sql("'group'", 'row_id', seed=7)} * 4) as integer) as varchar) as grp,
        cast({P.uniform_sql("'outcome'", 'row_id', seed=7)} < 0.1 * ({P.uniform_sql("'x1'", 'row_id', seed=7)} + {P.uniform_sql("'x2'", 'row_id', seed=7)}) as integer) as outcome,
        case when {P.uniform_sql("'hole3'", 'row_id', seed=7)} >= 0.3 then {P.uniform_sql("'x3'", 'row_id', seed=7)} end as x3 from r)
        select grp, count(*) as n, sum(outcome) as outcomes, count(x3) as known, avg(x3) as mean_x3 from x group by grp""",
    "grp, n, outcomes, known",
    "mean_x3",
)
def synthetic_rows(spark, d) -> DataFrame:
    made = formats.made_up(spark, 2000, measures=3, groups=4, rate=0.1, holes=0.3, seed=7)
    return made.groupBy("grp").agg(F.count("*").alias("n"), F.sum("outcome").alias("outcomes"), F.count("x3").alias("known"), F.avg("x3").alias("mean_x3"))


_TYPED = ["p_size", "p_retailprice", "p_partkey"]


@query(
    "variable_types",
    " union all ".join(
        f"select '{c}' as variable, count(distinct {c}) as n_distinct, case when count(distinct {c}) = 2 then 'binary' when count(distinct {c}) = count(*) then 'identifier' when count(distinct {c}) <= 60 then 'discrete' else 'continuous' end as kind from part" for c in _TYPED
    ),
    "variable, n_distinct, kind",
)
def variable_types(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    counts = screening.long_form(part, _TYPED).groupBy("variable").agg(F.countDistinct("value").alias("n_distinct"), F.count("*").alias("n"))
    kind = F.when(F.col("n_distinct") == 2, "binary").when(F.col("n_distinct") == F.col("n"), "identifier").when(F.col("n_distinct") <= 60, "discrete").otherwise("continuous")
    return counts.select("variable", "n_distinct", kind.alias("kind"))


@query(
    "spearman",
    """with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part) select corr(a, b) as rho from r""",
    "",
    "rho",
)
def spearman(spark, d) -> DataFrame:
    part = table(spark, d, "part").select("p_size", "p_retailprice")
    return order.tie_ranks(order.tie_ranks(part, "p_size", name="a"), "p_retailprice", name="b").agg(F.corr("a", "b").alias("rho"))


@query(
    "selection_funnel",
    f"""with {P.FEATURES_SQL}, c as ({' union all '.join(f"select '{c}' as variable, count({c}) / count(*) as coverage, count(distinct {c}) as n_distinct from feats" for c in P.FEATURES)})
        select 'all' as step, count(*) as n from c union all select 'covered', count(*) filter (coverage >= 0.85) from c union all select 'varied', count(*) filter (coverage >= 0.85 and n_distinct > 30) from c""",
    "step, n",
)
def selection_funnel(spark, d) -> DataFrame:
    c = screening.long_form(P.features(spark, d), P.FEATURES).groupBy("variable").agg((F.count("value") / F.count("*")).alias("coverage"), F.countDistinct("value").alias("n_distinct"))
    covered, varied = F.col("coverage") >= 0.85, (F.col("coverage") >= 0.85) & (F.col("n_distinct") > 30)
    t = c.agg(F.count("*").alias("all"), F.count_if(covered).alias("covered"), F.count_if(varied).alias("varied"))
    return t.selectExpr("stack(3, 'all', `all`, 'covered', covered, 'varied', varied) as (step, n)")


@query("cohort_rates", "select cast(floor((o_totalprice - 1000) / 50000) as bigint) as bucket, count(*) as n, avg(cast(o_orderstatus = 'F' as integer)) as rate from orders group by 1", "bucket, n", "rate")
def cohort_rates(spark, d) -> DataFrame:
    o = table(spark, d, "orders").withColumn("bucket", F.floor((F.col("o_totalprice") - 1000) / 50000))
    return o.groupBy("bucket").agg(F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("rate"))


@query("seed_sensitivity", f"with {P.BLOCKS_SQL}, m as (select model, avg(score) as mean_score, stddev_samp(score) as sd, max(score) - min(score) as spread from blocks group by model) select model, mean_score, sd, spread, mean_score - lead(mean_score) over (order by mean_score desc, model) as lead_over from m", "model", "mean_score, sd, spread, lead_over")
def seed_sensitivity(spark, d) -> DataFrame:
    m = P.blocks(spark, d).groupBy("model").agg(F.avg("score").alias("mean_score"), F.stddev("score").alias("sd"), (F.max("score") - F.min("score")).alias("spread"))
    return m.withColumn("lead_over", F.col("mean_score") - F.lead("mean_score").over(Window.orderBy(F.desc("mean_score"), "model")))


@query("group_sizes", "select n_lines, count(*) as n_orders, max(customers) as customers from (select l_orderkey, count(*) as n_lines, count(distinct l_suppkey) as customers from lineitem group by l_orderkey) group by n_lines", "n_lines, n_orders, customers")
def group_sizes(spark, d) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.countDistinct("l_suppkey").alias("customers"))
    return per.groupBy("n_lines").agg(F.count("*").alias("n_orders"), F.max("customers").alias("customers"))


@query("any_event_share", "select avg(any_late) as share from (select l_orderkey, max(cast(l_returnflag = 'R' as integer)) as any_late from lineitem group by l_orderkey)", "", "share")
def any_event_share(spark, d) -> DataFrame:
    flag = C.holds(F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(flag).alias("any_late")).agg(F.avg("any_late").alias("share"))


@query("equal_count_deciles", "select nth, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high from (select o_totalprice, ntile(10) over (order by o_totalprice, o_orderkey) as nth from orders) group by nth", "nth, n", "low, high")
def equal_count_deciles(spark, d) -> DataFrame:
    """Ten bins of equally many rows, by exact order statistics."""
    o = order.equal_count_bins(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), 10, F.col("o_totalprice"), F.col("o_orderkey"), name="nth")
    return o.groupBy("nth").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("describe_orders", "select 'o_totalprice' as variable, count(*) as n, avg(x) as mean, stddev_samp(x) as sd, quantile_cont(x, 0.5) as median from (select o_totalprice as x from orders)", "variable, n", "mean, sd, median")
def describe_orders(spark, d) -> DataFrame:
    return collapse.describe(table(spark, d, "orders"), ["o_totalprice"]).select("variable", "n", "mean", "sd", "median")
