"""The study's frames on the star schema, and the same frames as DuckDB SQL.

Customers are the entities, orders their history, order lines the second hop;
the target is a negative balance. A few values are set to missing or to the
sentinel by key, as the tables themselves have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.columns import uniform
from gneiss.operators.modelling import class_stats, log_odds
from gneiss.sources.storage import materialize, table

LAST_DAY = "2001-08-01"

HISTORY_SQL = f"""history as (
    select o_orderkey, o_custkey, case when o_orderkey % 11 <> 0 then o_totalprice end as amount,
           case when o_orderkey % 7 = 0 then 365243 else date_diff('day', date '{LAST_DAY}', cast(o_orderdate as date)) end as days_raw,
           date_diff('day', date '{LAST_DAY}', cast(o_orderdate as date)) as days, o_orderstatus as status, o_orderpriority as priority
    from orders)"""
LINES_SQL = """lines as (
    select l.l_orderkey as o_orderkey, o.o_custkey, l_linenumber, l_quantity, l_extendedprice + 0.0 as price, l_discount + 0.0 as discount, l_tax + 0.0 as tax,
           l_returnflag, l_linestatus, date_diff('day', cast(o.o_orderdate as date), cast(l_shipdate as date)) - 60 as late
    from lineitem l join orders o on l.l_orderkey = o.o_orderkey)"""
TARGET_SQL = "clients as (select c_custkey, c_nationkey, c_mktsegment, cast(c_acctbal < 0 as integer) as target from customer)"


def uniform_sql(*cols: str, seed: int = 42) -> str:
    text = " || '|' || ".join([*(f"cast({c} as varchar)" for c in cols), f"'{seed}'"])
    return f"(cast(cast('0x' || substr(md5({text}), 1, 8) as ubigint) as double) / 4294967296.0)"


def order_sql(*cols: str, seed: int = 42) -> str:
    return "md5(" + " || '|' || ".join([*(f"cast({c} as varchar)" for c in cols), f"'{seed}'"]) + ")"


FEATURES_SQL = f"""{TARGET_SQL}, {HISTORY_SQL}, feats as (
    select c.c_custkey, c.target, c.c_nationkey, avg(h.amount) as mean_amount, max(h.amount) as max_amount, coalesce(sum(h.amount), 0) as total_amount,
           cast(count(h.o_orderkey) as double) as n_orders, avg(case when h.days_raw <> 365243 then h.days_raw end) as mean_days,
           case when c.c_custkey % 5 <> 0 then cast(sum(case when h.status = 'F' then 1 else 0 end) as double) end as closed, {uniform_sql('c.c_custkey')} as u
    from clients c left join history h on h.o_custkey = c.c_custkey group by c.c_custkey, c.target, c.c_nationkey)"""
FEATURES = ["mean_amount", "max_amount", "total_amount", "n_orders", "mean_days", "closed"]

#: Columns of two naive Bayes models; the tables hold no column that tells a negative balance, so a noisy measurement of it stands in.
MODELS = {"s": ["sign_1", "mean_amount", "n_orders", "closed"], "s2": ["sign_2", "max_amount", "mean_days"]}
SIGNS = {"sign_1": (0.3, 1), "sign_2": (0.2, 2)}
SMOOTHING = 1e-9


def _moments_sql(columns: list[str]) -> str:
    own = ", ".join(f"avg({c}) filter (target = {k}) as m{k}_{c}, var_pop({c}) filter (target = {k}) as v{k}_{c}" for c in columns for k in (0, 1))
    return f"{own}, {', '.join(f'var_pop({c}) as w_{c}' for c in columns)}"


def _score_sql(columns: list[str]) -> str:
    """Chance of a negative balance under a model that takes both classes as equally frequent."""
    extra = f"{SMOOTHING} * greatest({', '.join('w_' + c for c in columns)})"
    term = lambda k, c: f"(-ln(v{k}_{c} + {extra}) / 2 - ({c} - m{k}_{c}) * ({c} - m{k}_{c}) / (2 * (v{k}_{c} + {extra})))"
    return "1 / (1 + exp(-(" + " + ".join(f"coalesce({term(1, c)} - {term(0, c)}, 0)" for c in columns) + ")))"


#: Scores of the two models, fitted on customers with u < 0.8, of all customers, and the target. Customers without orders have ties.
SCORES_SQL = f"""{FEATURES_SQL}, signed as (select *, {', '.join(f"round({gain} * target + {1 - gain} * {uniform_sql('c_custkey', seed=seed)}, 2) as {c}" for c, (gain, seed) in SIGNS.items())} from feats),
    moments as (select {_moments_sql([c for own in MODELS.values() for c in own])} from signed where u < 0.8),
    scored as (
    select c_custkey as row, target as y, {', '.join(f'{_score_sql(own)} as {name}' for name, own in MODELS.items())},
           cast(floor({uniform_sql('c_custkey', seed=3)} * 5) as integer) as fold from signed, moments)"""
#: Errors of two models over ordered rows.
ERRORS_SQL = f"""errors as (
    select o_orderkey as row, {uniform_sql('o_orderkey', seed=4)} - 0.5 as e1, {uniform_sql('o_orderkey', seed=5)} - 0.45 as e2, {uniform_sql('o_orderkey', seed=6)} as y from orders)"""
#: Scores of five models in as many blocks as there are parts.
BLOCKS_SQL = f"""models as (select * from (values ('a', 0.00), ('b', 0.01), ('c', 0.02), ('d', 0.05), ('e', 0.05)) t(model, gain)), blocks as (
    select p_partkey as block, model, round(0.7 + gain + 0.05 * {uniform_sql('p_partkey', 'model', seed=7)}, 3) as score from part, models)"""


#: A log of launches, an entry for each event; every third kind of event ends in an error.
LOG_SQL = """log as (
    select user_id as unit, event_type as method, '== launch ' || cast(event_id as varchar) || chr(10) || case event_id % 6
        when 0 then 'TimeoutError: no result after 60 s' when 2 then 'MemoryError: unable to allocate 3 GB' when 4 then 'ValueError: input contains NaN' else 'done: no Error: here' end || chr(10) || 'end' as entry
    from events)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    outcome = F.when(k == 0, "TimeoutError: no result after 60 s").when(k == 2, "MemoryError: unable to allocate 3 GB").when(k == 4, "ValueError: input contains NaN").otherwise("done: no Error: here")
    return table(spark, d, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("method"), F.concat(F.lit("== launch "), F.col("event_id").cast("string"), F.lit("\n"), outcome, F.lit("\nend")).alias("entry"))


def clients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") < 0).cast("int").alias("target"))


def history(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit(LAST_DAY).cast("date"))
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("amount"), F.when(F.col("o_orderkey") % 7 == 0, 365243).otherwise(days).alias("days_raw"),
        days.alias("days"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey"), "o_custkey", "o_orderdate")
    both = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(orders, "o_orderkey")
    late = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) - 60
    zero = lambda c, name: (F.col(c) + F.lit(0.0)).alias(name)
    return both.select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity", zero("l_extendedprice", "price"), zero("l_discount", "discount"), zero("l_tax", "tax"), "l_returnflag", "l_linestatus", late.alias("late"))


def features(spark: SparkSession, d: str) -> DataFrame:
    h = history(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.avg("amount").alias("mean_amount"), F.max("amount").alias("max_amount"), F.sum("amount").alias("t"), F.count("*").alias("n"),
        F.avg(F.when(F.col("days_raw") != 365243, F.col("days_raw"))).alias("mean_days"), F.sum(F.when(F.col("status") == "F", 1).otherwise(0)).alias("f"),
    )
    wide = clients(spark, d).join(h, "c_custkey", "left")
    return wide.select(
        "c_custkey", "target", "c_nationkey", "mean_amount", "max_amount", F.coalesce("t", F.lit(0.0)).alias("total_amount"), F.coalesce("n", F.lit(0)).cast("double").alias("n_orders"), "mean_days",
        F.when(F.col("c_custkey") % 5 != 0, F.coalesce("f", F.lit(0)).cast("double")).alias("closed"), uniform("c_custkey").alias("u"),
    )


def scores(spark: SparkSession, d: str) -> DataFrame:
    f = features(spark, d)
    signs = {c: F.round(gain * F.col("target") + (1 - gain) * uniform("c_custkey", seed=seed), 2) for c, (gain, seed) in SIGNS.items()}
    # two branches need it, and it is a join of the customers with their history
    signed = materialize(f.withColumns(signs).select("c_custkey", "target", "u", *(c for own in MODELS.values() for c in own)), "signed")
    stats = signed.where("u < 0.8").agg(*class_stats([c for own in MODELS.values() for c in own], "target"))
    scored = signed.crossJoin(F.broadcast(stats))  # one row of statistics
    models = [(1 / (1 + F.exp(F.log(F.col("n_1") / F.col("n_0")) - log_odds(own, SMOOTHING)))).alias(name) for name, own in MODELS.items()]  # classes as equally frequent
    return scored.select(F.col("c_custkey").alias("row"), F.col("target").alias("y"), *models, F.floor(uniform("c_custkey", seed=3) * 5).cast("int").alias("fold"))


def errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("row"), (uniform(k, seed=4) - 0.5).alias("e1"), (uniform(k, seed=5) - 0.45).alias("e2"), uniform(k, seed=6).alias("y"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    models = spark.createDataFrame([("a", 0.0), ("b", 0.01), ("c", 0.02), ("d", 0.05), ("e", 0.05)], "model string, gain double")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("block"))
    return part.crossJoin(models).select("block", "model", F.round(0.7 + F.col("gain") + 0.05 * uniform("block", "model", seed=7), 3).alias("score"))


def tidy_sql(body: str, plain: str = "", doubles: str = "", digits: int = 6) -> str:
    """``body`` is a query or "with ... select"; doubles are rounded like :func:`gneiss.functions.columns.tidy`."""
    columns = [c.strip() for c in plain.split(",") if c.strip()] + [f"round(cast({c.strip()} as double), {digits}) + 0.0 as {c.strip()}" for c in doubles.split(",") if c.strip()]
    return f"select {', '.join(columns)} from ({body}) t"
