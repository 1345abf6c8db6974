"""Derivation, collapse, join and window queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import collapse, joins
from gneiss.plans import frames as P
from gneiss.sources.storage import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, plain: str = "", doubles: str = "", digits: int = 6):
    """Register a query (its doubles rounded) with its SQL."""

    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


STATUS = ["F", "O", "P"]
_SUMMARY = ", ".join(
    [f"{e} as PREV_{c}_{s}" for c in ("AMOUNT", "DAYS") for s, e in (("MEAN", f"avg({c})"), ("MAX", f"max({c})"), ("MIN", f"min({c})"), ("SUM", f"coalesce(sum({c}), 0)"))]
    + [f"avg(case when status = '{v}' then 1.0 else 0.0 end) as PREV_STATUS_{v}_MEAN, cast(sum(case when status = '{v}' then 1 else 0 end) as bigint) as PREV_STATUS_{v}_SUM" for v in STATUS]
)


@query(
    "summarize_history",
    f"with {P.HISTORY_SQL} select o_custkey, {_SUMMARY}, count(*) as PREV_COUNT from history group by o_custkey",
    "o_custkey, PREV_COUNT, PREV_DAYS_MAX, PREV_DAYS_MIN, PREV_DAYS_SUM, " + ", ".join(f"PREV_STATUS_{v}_SUM" for v in STATUS),
    "PREV_AMOUNT_MEAN, PREV_AMOUNT_MAX, PREV_AMOUNT_MIN, PREV_AMOUNT_SUM, PREV_DAYS_MEAN, " + ", ".join(f"PREV_STATUS_{v}_MEAN" for v in STATUS),
    7,
)
def summarize_history(spark, d) -> DataFrame:
    return collapse.summarize(P.history(spark, d), "o_custkey", "PREV", ["amount", "days"], {"status": STATUS})


@query(
    "feature_table",
    f"""with {P.TARGET_SQL}, {P.HISTORY_SQL}, s as (select o_custkey as c_custkey, avg(amount) as PREV_AMOUNT_MEAN, max(amount) as PREV_AMOUNT_MAX, min(amount) as PREV_AMOUNT_MIN,
        coalesce(sum(amount), 0) as PREV_AMOUNT_SUM, count(*) as PREV_COUNT from history group by o_custkey),
        e as (select user_id as c_custkey, avg(value) as CC_VALUE_MEAN, max(value) as CC_VALUE_MAX, min(value) as CC_VALUE_MIN, coalesce(sum(value), 0) as CC_VALUE_SUM, count(*) as CC_COUNT from events group by user_id)
        select c_custkey, target, PREV_AMOUNT_MEAN, PREV_AMOUNT_SUM, PREV_COUNT, CC_VALUE_MEAN, CC_COUNT, cast(PREV_COUNT is not null as integer) as HIST_PREV, cast(CC_COUNT is not null as integer) as HIST_CC,
        cast(PREV_COUNT is not null as integer) + cast(CC_COUNT is not null as integer) as HIST_N from clients left join s using (c_custkey) left join e using (c_custkey)""",
    "c_custkey, target, PREV_COUNT, CC_COUNT, HIST_PREV, HIST_CC, HIST_N",
    "PREV_AMOUNT_MEAN, PREV_AMOUNT_SUM, CC_VALUE_MEAN",
    7,
)
def feature_table(spark, d) -> DataFrame:
    prev = collapse.summarize(P.history(spark, d).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "PREV", ["amount"])
    cc = collapse.summarize(table(spark, d, "events").withColumnRenamed("user_id", "c_custkey"), "c_custkey", "CC", ["value"])
    wide = joins.feature_join(joins.feature_join(P.clients(spark, d), prev, "c_custkey"), cc, "c_custkey")
    flags = [C.present("PREV_COUNT").alias("HIST_PREV"), C.present("CC_COUNT").alias("HIST_CC")]
    return wide.select("c_custkey", "target", "PREV_AMOUNT_MEAN", "PREV_AMOUNT_SUM", "PREV_COUNT", "CC_VALUE_MEAN", "CC_COUNT", *flags, C.total([C.present("PREV_COUNT"), C.present("CC_COUNT")]).alias("HIST_N"))


@query(
    "two_hop",
    f"""with {P.LINES_SQL}, near as (select o_orderkey, avg(price) as a, max(price) as b, min(price) as c, coalesce(sum(price), 0) as s, count(*) as n from lines group by o_orderkey),
        wide as (select o_custkey, a, b, c, s, n from orders left join near using (o_orderkey))
        select o_custkey, avg(a) as BURO_BB_PRICE_MEAN_MEAN, coalesce(sum(s), 0) as BURO_BB_PRICE_SUM_SUM, avg(n) as BURO_BB_COUNT_MEAN, count(*) as BURO_COUNT from wide group by o_custkey""",
    "o_custkey, BURO_COUNT",
    "BURO_BB_PRICE_MEAN_MEAN, BURO_BB_PRICE_SUM_SUM, BURO_BB_COUNT_MEAN",
    8,
)
def two_hop(spark, d) -> DataFrame:
    out = collapse.two_hop(P.lines(spark, d), table(spark, d, "orders"), "o_orderkey", "o_custkey", "BB", "BURO", ["price"])
    return out.select("o_custkey", "BURO_COUNT", "BURO_BB_PRICE_MEAN_MEAN", "BURO_BB_PRICE_SUM_SUM", "BURO_BB_COUNT_MEAN")


@query(
    "derived_history",
    f"""with {P.HISTORY_SQL} select o_orderkey, nullif(days_raw, 365243) as days_clean, cast(days_raw = 365243 as integer) as was_sentinel, cast(amount is null as integer) as amount_missing,
        cast(coalesce(amount > 150000, false) as integer) as large, case status when 'F' then 0.0 when 'O' then 1.0 end as status_num, cast(priority in ('1-URGENT', '2-HIGH') as integer) as urgent,
        floor(-days / 365.25) as years, case when amount is not null then least(greatest(amount, 1000), 200000) end as amount_clipped from history""",
    "o_orderkey, days_clean, was_sentinel, amount_missing, large, urgent",
    "status_num, years, amount_clipped",
)
def derived_history(spark, d) -> DataFrame:
    return P.history(spark, d).select(
        "o_orderkey", C.without_sentinel("days_raw").alias("days_clean"), C.holds(F.col("days_raw") == C.NO_DATE).alias("was_sentinel"), C.missing("amount").alias("amount_missing"),
        C.holds(F.col("amount") > 150000).alias("large"), C.ordinal("status", {"F": 0, "O": 1}).alias("status_num"), C.holds(F.col("priority").isin("1-URGENT", "2-HIGH")).alias("urgent"),
        F.floor(-F.col("days") / 365.25).cast("double").alias("years"), C.clip("amount", 1000, 200000).alias("amount_clipped"),
    )


@query(
    "payment_flags",
    f"""with {P.LINES_SQL} select o_custkey, sum(cast(late > 0 as integer)) as paid_late, sum(cast(1 - discount < 0.999 as integer)) as partial, avg(tax / nullif(discount, 0)) as ratio, count(tax / nullif(discount, 0)) as n_ratio
        from lines group by o_custkey""",
    "o_custkey, paid_late, partial, n_ratio",
    "ratio",
)
def payment_flags(spark, d) -> DataFrame:
    rows = P.lines(spark, d).select("o_custkey", C.holds(F.col("late") > 0).alias("l"), C.holds(1 - F.col("discount") < 0.999).alias("p"), C.ratio("tax", "discount").alias("r"))
    return rows.groupBy("o_custkey").agg(F.sum("l").alias("paid_late"), F.sum("p").alias("partial"), F.avg("r").alias("ratio"), F.count("r").alias("n_ratio"))


@query(
    "profile_history",
    f"""with {P.HISTORY_SQL}, per as (select o_custkey, count(*) as n, min(days) as oldest from history group by o_custkey)
        select cast(sum(n) as bigint) as n_rows, count(*) as entities, quantile_cont(n, 0.5) as median_rows, quantile_cont(n, 0.95) as p95_rows, max(n) as max_rows, count(c_custkey) as covered, abs(min(oldest)) as depth,
        (select count(*) from customer) as universe, count(c_custkey) / (select count(*) from customer) as coverage from per left join customer on o_custkey = c_custkey""",
    "n_rows, entities, max_rows, covered, depth, universe",
    "median_rows, p95_rows, coverage",
)
def profile_history(spark, d) -> DataFrame:
    return collapse.profile(P.history(spark, d), "o_custkey", "days", table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"))


@query(
    "missing_table",
    f"with {P.FEATURES_SQL} " + " union all ".join(f"select '{c}' as variable, count(*) - count({c}) as n_missing, 100.0 * (count(*) - count({c})) / count(*) as pct_missing from feats" for c in P.FEATURES),
    "variable, n_missing",
    "pct_missing",
)
def missing_table(spark, d) -> DataFrame:
    return collapse.missing_table(P.features(spark, d), P.FEATURES)


@query("frequencies", "select p_brand, count(*) as n, count(*) / (select count(*) from part) as share from part group by p_brand", "p_brand, n", "share")
def frequencies(spark, d) -> DataFrame:
    return collapse.frequencies(table(spark, d, "part"), "p_brand")


@query(
    "crosstab",
    "select o_orderpriority, " + ", ".join(f"count(*) filter (o_orderstatus = '{v}') as o_orderstatus_{v}" for v in STATUS) + " from orders group by o_orderpriority",
    "o_orderpriority, " + ", ".join(f"o_orderstatus_{v}" for v in STATUS),
)
def crosstab(spark, d) -> DataFrame:
    return collapse.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", STATUS)


_SKEW = "(avg(pow(x, 3)) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3)) / pow(var_pop(x), 1.5) * sqrt(count(x) * (count(x) - 1.0)) / (count(x) - 2)"


@query(
    "describe",
    " union all ".join(
        f"select '{c}' as variable, count(x) as n, avg(x) as mean, stddev_samp(x) as sd, min(x) as low, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3, max(x) as high, "
        f"{_SKEW} as skew, max(x) / quantile_cont(x, 0.5) as extremeness from (select cast({c} as double) as x from part)"
        for c in ("p_size", "p_retailprice")
    ),
    "variable, n",
    "mean, sd, low, q1, median, q3, high, skew, extremeness",
    7,
)
def describe(spark, d) -> DataFrame:
    return collapse.describe(table(spark, d, "part"), ["p_size", "p_retailprice"])


@query("orphans", "select count(distinct l_orderkey) as keys, count(distinct l_orderkey) filter (l_orderkey not in (select o_orderkey from orders where o_orderkey % 3 <> 0)) as orphans from lineitem", "keys, orphans")
def orphans(spark, d) -> DataFrame:
    parent = table(spark, d, "orders").where("o_orderkey % 3 <> 0")
    return joins.orphans(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), parent, "o_orderkey")


@query("join_integrity", "select 'orders' as source, (select count(*) from customer) as rows_before, (select count(*) from customer left join orders on c_custkey = o_custkey) as rows_after, false as kept", "source, rows_before, rows_after, kept")
def join_integrity(spark, d) -> DataFrame:
    return joins.integrity(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "orders")


@query("duplicate_share", "select cast(sum(n) as bigint) as n_rows, count(*) as n_distinct, 1 - count(*) / sum(n) as share from (select count(*) as n from lineitem group by l_orderkey, l_linenumber)", "n_rows, n_distinct", "share")
def duplicate_share(spark, d) -> DataFrame:
    return collapse.duplicate_share(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "mode_share",
    " union all ".join(f"select '{c}' as variable, max(n) as top, cast(sum(n) as bigint) as n, count(*) as n_values, max(n) / sum(n) as share from (select count(*) as n from lineitem group by {c})" for c in ("l_returnflag", "l_linestatus", "l_linenumber")),
    "variable, top, n, n_values",
    "share",
)
def mode_share(spark, d) -> DataFrame:
    return collapse.mode_share(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "largest_order",
    "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as nth from orders) where nth = 1",
    "o_custkey, o_orderkey",
    "o_totalprice",
)
def largest_order(spark, d) -> DataFrame:
    return collapse.row_at_extreme(table(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "recency_window",
    f"with {P.HISTORY_SQL} select o_custkey, avg(amount) as all_mean, avg(amount) filter (days >= -365) as year_mean, count(*) filter (days >= -365) as year_n from history group by o_custkey",
    "o_custkey, year_n",
    "all_mean, year_mean",
    7,
)
def recency_window(spark, d) -> DataFrame:
    recent = F.col("days") >= -365
    return P.history(spark, d).groupBy("o_custkey").agg(F.avg("amount").alias("all_mean"), F.avg(F.when(recent, F.col("amount"))).alias("year_mean"), F.count(F.when(recent, 1)).alias("year_n"))


@query(
    "best_so_far",
    "select event_id, max(value) over w as best, sum(value) over w as running, epoch(lead(ts) over (partition by user_id order by ts, event_id)) - epoch(ts) as gap_s, row_number() over (partition by user_id order by ts, event_id) as nth from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)",
    "event_id, nth",
    "best, running, gap_s",
    3,
)
def best_so_far(spark, d) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    w = order.rowsBetween(Window.unboundedPreceding, 0)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return table(spark, d, "events").select(
        "event_id", F.max("value").over(w).alias("best"), F.sum("value").over(w).alias("running"), (seconds(F.lead("ts").over(order)) - seconds(F.col("ts"))).alias("gap_s"), F.row_number().over(order).cast("long").alias("nth")
    )


@query(
    "rolling_mean",
    "select event_id, case when count(value) over w = 8 then avg(value) over w end as mean8 from events window w as (partition by user_id order by ts, event_id rows between 4 preceding and 3 following)",
    "event_id",
    "mean8",
)
def rolling_mean(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 3)
    return table(spark, d, "events").select("event_id", F.when(F.count("value").over(w) == 8, F.avg("value").over(w)).alias("mean8"))


@query(
    "stratified_split",
    f"""with {P.TARGET_SQL} select c_custkey, target, case when r < 0.2 then 'test' when r < 0.36 then 'validation' else 'train' end as part, cast((nth - 1) % 5 as integer) as fold
        from (select *, (nth - 1.0) / n as r from (select *, row_number() over (partition by target order by {P.order_sql('c_custkey')}, c_custkey) as nth, count(*) over (partition by target) as n from clients))""",
    "c_custkey, target, part, fold",
)
def stratified_split(spark, d) -> DataFrame:
    from gneiss.operators.splits import stratified

    return stratified(P.clients(spark, d), "c_custkey", "target", {"test": 0.2, "validation": 0.16, "train": 0.64}, folds=5).select("c_custkey", "target", "part", "fold")


@query(
    "class_weights",
    f"with {P.TARGET_SQL} select target, count(*) as n, sum(count(*)) over () / (2.0 * count(*)) as weight from clients group by target",
    "target, n",
    "weight",
)
def class_weights(spark, d) -> DataFrame:
    from gneiss.operators.splits import class_weights as weights

    return weights(P.clients(spark, d), "target")


@query(
    "impute_and_scale",
    f"""with {P.FEATURES_SQL}, fit as (select quantile_cont(closed, 0.5) filter (u < 0.8) as m from feats), filled as (select c_custkey, u, coalesce(closed, m) as x from feats, fit)
        select c_custkey, (x - (select avg(x) from filled where u < 0.8)) / (select stddev_pop(x) from filled where u < 0.8) as closed from filled""",
    "c_custkey",
    "closed",
)
def impute_and_scale(spark, d) -> DataFrame:
    from gneiss.operators.splits import impute_median, standardize

    f = P.features(spark, d)
    fit = f.where("u < 0.8")
    filled = impute_median(fit, f, ["closed"])
    return standardize(filled.where("u < 0.8"), filled, ["closed"]).select("c_custkey", "closed")


@query(
    "pooled_one_hot",
    "with t as (select p_partkey, p_type, count(*) over (partition by p_type) as n from part) select p_partkey, " + ", ".join(f"cast(p_type = '{v}' and n >= 20 as integer) as is_{i}" for i, v in enumerate(["ECONOMY", "SMALL"])) + ", cast(n < 20 as integer) as pooled from t",
    "p_partkey, is_0, is_1, pooled",
)
def pooled_one_hot(spark, d) -> DataFrame:
    from gneiss.operators.splits import pool_rare

    part = table(spark, d, "part")
    pooled = pool_rare(part, part, "p_type", 20)
    return pooled.select("p_partkey", *(C.holds(F.col("p_type") == v).alias(f"is_{i}") for i, v in enumerate(["ECONOMY", "SMALL"])), C.holds(F.col("p_type") == "__rare__").alias("pooled"))


@query(
    "nearest_neighbours",
    """with q as (select vec_id as query, embedding as x from embeddings where vec_id % 100 = 0), d as (select query, vec_id as point, list_distance(cast(x as double[]), cast(embedding as double[])) as distance from q, embeddings where vec_id <> query)
       select query, point, distance, nth from (select *, row_number() over (partition by query order by distance, point) as nth from d) where nth <= 5""",
    "query, point, nth",
    "distance",
)
def nearest_neighbours(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return joins.nearest(v.where("id % 100 = 0"), v, 5).withColumn("nth", F.col("nth").cast("long"))


@query(
    "grand_total",
    "select coalesce(o_orderstatus, 'ALL') as status, count(*) as n, sum(o_totalprice) as total from orders group by rollup (o_orderstatus)",
    "status, n",
    "total",
    2,
)
def grand_total(spark, d) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("status"), "n", "total")


@query("origin_by_prefix", "select p_name, case when p_name like 'BURO_BB%' then 'BURO_BB' when p_name like 'BURO%' then 'BURO' else 'OTHER' end as origin from (select concat(case p_partkey % 3 when 0 then 'BURO_BB_' when 1 then 'BURO_' else 'X_' end, p_name) as p_name from part)", "p_name, origin")
def origin_by_prefix(spark, d) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.concat(F.when(k == 0, "BURO_BB_").when(k == 1, "BURO_").otherwise("X_"), "p_name").alias("p_name")
    return table(spark, d, "part").select(name).select("p_name", C.longest_prefix("p_name", ["BURO", "BURO_BB"], "OTHER").alias("origin"))


@query("json_parameters", "select event_type, cast(json_extract_string(props, '$.k') as integer) as k, count(*) as n from events group by 1, 2", "event_type, k, n")
def json_parameters(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query(
    "log_errors",
    f"""with {P.LOG_SQL} select unit, sum(len(regexp_extract_all(entry, '(?m)^== launch \\d+'))) as launches, sum(len(regexp_extract_all(entry, '(?m)^\\w+Error: '))) as errors,
        max(regexp_extract(entry, '(?m)^(\\w+Error): ', 1)) as last_name from log group by unit""",
    "unit, launches, errors, last_name",
)
def log_errors(spark, d) -> DataFrame:
    """Launches and errors in a log of entries of several lines, by patterns anchored to line starts."""
    count = lambda pattern: F.sum(F.regexp_count("entry", F.lit(pattern))).cast("long")
    return P.log(spark, d).groupBy("unit").agg(count(r"(?m)^== launch \d+").alias("launches"), count(r"(?m)^\w+Error: ").alias("errors"), F.max(F.regexp_extract("entry", r"(?m)^(\w+Error): ", 1)).alias("last_name"))


@query(
    "sample_by_hash",
    f"select c_custkey from (select c_custkey, row_number() over (order by {P.order_sql('c_custkey', seed=9)}, c_custkey) as nth from customer) where nth <= 100",
    "c_custkey",
)
def sample_by_hash(spark, d) -> DataFrame:
    return table(spark, d, "customer").orderBy(C.hash_order("c_custkey", seed=9), "c_custkey").limit(100).select("c_custkey")


@query(
    "polynomial_terms",
    "select p_partkey, a, b, a * a as aa, a * b as ab, b * b as bb, a * a * a as aaa, a * a * b as aab, a * b * b as abb, b * b * b as bbb from (select p_partkey, p_size / 50.0 as a, p_retailprice / 1000 as b from part)",
    "p_partkey",
    "a, b, aa, ab, bb, aaa, aab, abb, bbb",
)
def polynomial_terms(spark, d) -> DataFrame:
    from gneiss.operators.splits import polynomial

    part = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), (F.col("p_retailprice") / 1000).alias("b"))
    return polynomial(part, ["a", "b"], 3)
