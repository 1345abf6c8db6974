"""Folds, baselines, lookups, residual tables and cell-based neighbours, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import inference, order, quantiles, screening, splits
from gneiss.plans import frames as P
from gneiss.sources.storage import table

#: Recall that a search through the index is set up for, on the sample.
RECALL = 0.94

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: str = "", doubles: str = "", digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        if sql:
            ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


@query("lookup_map", "select n_name as nation, count(*) as n, count(c_acctbal) as known from customer left join nation on n_nationkey = c_nationkey group by n_name", "nation, n, known")
def lookup_map(spark, d) -> DataFrame:
    """Codes as names through a left join with a lookup table."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return table(spark, d, "customer").join(names, "c_nationkey", "left").groupBy("nation").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("known"))


@query(
    "side_by_side",
    "select o_custkey, o.n as orders, coalesce(l.n, 0) as urgent from (select o_custkey, count(*) as n from orders group by 1) o left join (select o_custkey, count(*) as n from orders where o_orderpriority = '1-URGENT' group by 1) l using (o_custkey)",
    "o_custkey, orders, urgent",
)
def side_by_side(spark, d) -> DataFrame:
    """Two summaries of one key, column by column."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    urgent = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("urgent"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("orders")).join(urgent, "o_custkey", "left").select("o_custkey", "orders", F.coalesce("urgent", F.lit(0)).cast("long").alias("urgent"))


@query(
    "alignment",
    "select count(*) filter (l is null) as only_orders, count(*) filter (o is null) as only_lines, count(*) filter (o is not null and l is not null) as both_sides from (select distinct o_orderkey as o from orders) full join (select distinct l_orderkey as l from lineitem) on o = l",
    "only_orders, only_lines, both_sides",
)
def alignment(spark, d) -> DataFrame:
    """Whether two tables hold the same row ids."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).distinct().withColumn("a", F.lit(1))
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "id", "full").agg(F.count_if(F.col("b").isNull()).alias("only_orders"), F.count_if(F.col("a").isNull()).alias("only_lines"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"))


@query("largest_magnitudes", "select c_custkey, c_acctbal from customer order by abs(c_acctbal) desc, c_custkey limit 25", "c_custkey", "c_acctbal")
def largest_magnitudes(spark, d) -> DataFrame:
    """Top 25 by absolute value (a top-k report)."""
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc(F.abs("c_acctbal")), "c_custkey").limit(25)


@query(
    "column_sets",
    "with a as (select column_name as name from (describe orders)), b as (select column_name as name from (describe (select o_orderkey, l_quantity from orders join lineitem on l_orderkey = o_orderkey))) select name, a.name is not null as in_first, b.name is not null as in_second from a full join b using (name)",
    "name, in_first, in_second",
)
def column_sets(spark, d) -> DataFrame:
    """Column names of two tables: in the first, in the second, in both."""
    first, second = table(spark, d, "orders").columns, ["o_orderkey", "l_quantity"]
    return spark.createDataFrame([(c, c in first, c in second) for c in sorted({*first, *second})], "name string, in_first boolean, in_second boolean")


@query(
    "near_constant_columns",
    " union all ".join(f"select '{c}' as variable, count(distinct {c}) as n_distinct, count(*) - count({c}) as missing, count(distinct {c}) <= 1 or count({c}) < 0.05 * count(*) as dropped from (select *, 1 as one, case when p_partkey % 50 = 0 then p_size end as rare from part)" for c in ("p_size", "p_retailprice", "one", "rare")),
    "variable, n_distinct, missing, dropped",
)
def near_constant_columns(spark, d) -> DataFrame:
    """Columns to drop: constant ones and nearly empty ones."""
    part = table(spark, d, "part").withColumns({"one": F.lit(1), "rare": F.when(F.col("p_partkey") % 50 == 0, F.col("p_size"))})
    long = screening.long_form(part, ["p_size", "p_retailprice", "one", "rare"])
    t = long.groupBy("variable").agg(F.countDistinct("value").alias("n_distinct"), F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("n"))
    return t.select("variable", "n_distinct", "missing", ((F.col("n_distinct") <= 1) | (F.col("n") - F.col("missing") < 0.05 * F.col("n"))).alias("dropped"))


@query(
    "measurement_scales",
    "select 'priority' as variable, 'ordinal' as scale, count(distinct o_orderpriority) as n_distinct from orders union all select 'status', 'nominal', count(distinct o_orderstatus) from orders union all select 'price', case when min(o_totalprice) >= 0 then 'ratio' else 'interval' end, count(distinct o_totalprice) from orders union all select 'balance', case when min(c_acctbal) >= 0 then 'ratio' else 'interval' end, count(distinct c_acctbal) from customer",
    "variable, scale, n_distinct",
)
def measurement_scales(spark, d) -> DataFrame:
    """Scale of each variable: names are nominal, ranked names ordinal, numbers interval or (never negative) ratio."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    names = [("priority", "ordinal", o, "o_orderpriority"), ("status", "nominal", o, "o_orderstatus"), ("price", None, o, "o_totalprice"), ("balance", None, c, "c_acctbal")]
    out = None
    for name, scale, df, column in names:
        kind = F.lit(scale) if scale else F.when(F.min(column) >= 0, "ratio").otherwise("interval")
        row = df.agg(kind.alias("scale"), F.countDistinct(column).alias("n_distinct")).select(F.lit(name).alias("variable"), "scale", "n_distinct")
        out = row if out is None else out.unionByName(row)
    return out


_LINE_SQL = f"{P.LINES_SQL}"


@query(
    "line_ratios",
    f"with {_LINE_SQL} select o_custkey, avg(discount / nullif(price, 0)) as discount_rate, avg(tax / nullif(price, 0)) as tax_rate, sum(price * (1 - discount)) / nullif(sum(price), 0) as kept_share, max(price / nullif(l_quantity, 0)) as unit_price, sum(greatest(price * discount, 0)) as shortfall from lines group by o_custkey",
    "o_custkey",
    "discount_rate, tax_rate, kept_share, unit_price, shortfall",
)
def line_ratios(spark, d) -> DataFrame:
    """Four ratios and the shortfall of a client's lines."""
    price, given = F.col("price"), F.col("price") * F.col("discount")
    return P.lines(spark, d).groupBy("o_custkey").agg(
        F.avg(C.ratio("discount", "price")).alias("discount_rate"), F.avg(C.ratio("tax", "price")).alias("tax_rate"), C.ratio(F.sum(price - given), F.sum(price)).alias("kept_share"),
        F.max(C.ratio("price", "l_quantity")).alias("unit_price"), F.sum(F.greatest(given, F.lit(0.0))).alias("shortfall"),
    )


_NTH = "row_number() over (partition by {by} order by {order}, c_custkey)"


def _ordered(seed: int) -> str:
    return P.order_sql("c_custkey", seed=seed)


@query(
    "nested_folds",
    f"""with {P.TARGET_SQL}, o as (select c_custkey, target, cast(({_NTH.format(by='target', order=_ordered(42))} - 1) % 5 as integer) as outer_fold from clients), """
    + ", ".join(f"i{k} as (select c_custkey, target, {k} as without, cast(({_NTH.format(by='target', order=_ordered(43 + k))} - 1) % 3 as integer) as inner_fold from o where outer_fold <> {k})" for k in range(5))
    + " select without, inner_fold, count(*) as n, sum(target) as positives, min(c_custkey) as first_key from (" + " union all ".join(f"select * from i{k}" for k in range(5)) + ") group by 1, 2",
    "without, inner_fold, n, positives, first_key",
)
def nested_folds(spark, d) -> DataFrame:
    """Inner folds within the training part of each outer fold, all stratified."""
    outer = splits.stratified(P.clients(spark, d).select("c_custkey", "target"), "c_custkey", "target", {"all": 1.0}).withColumnRenamed("fold", "outer_fold").drop("part")
    out = None
    for k in range(5):
        rows = splits.stratified(outer.where(F.col("outer_fold") != k), "c_custkey", "target", {"all": 1.0}, folds=3, seed=43 + k).withColumn("without", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("without", F.col("fold").alias("inner_fold")).agg(F.count("*").alias("n"), F.sum("target").alias("positives"), F.min("c_custkey").alias("first_key"))


@query(
    "early_stop_part",
    f"with {P.TARGET_SQL}, r as (select *, {_NTH.format(by='target', order=_ordered(42))} - 1 as nth, count(*) over (partition by target) as m from clients) select case when nth / m < 0.9 then 'fit' else 'stop' end as part, count(*) as n, sum(target) as positives, min(c_custkey) as first_key from r group by 1",
    "part, n, positives, first_key",
)
def early_stop_part(spark, d) -> DataFrame:
    """A tenth of each class is held out to stop boosting early."""
    rows = splits.stratified(P.clients(spark, d).select("c_custkey", "target"), "c_custkey", "target", {"fit": 0.9, "stop": 0.1})
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("target").alias("positives"), F.min("c_custkey").alias("first_key"))


@query(
    "partition_summary",
    f"with {P.FEATURES_SQL} select case when u < 0.8 then 'dev' else 'test' end as part, count(*) as n, sum(target) as positives, avg(target) as rate, count(mean_amount) as known_amount, count(closed) as known_closed from feats group by 1",
    "part, n, positives, known_amount, known_closed",
    "rate",
)
def partition_summary(spark, d) -> DataFrame:
    f = P.features(spark, d).withColumn("part", F.when(F.col("u") < 0.8, "dev").otherwise("test"))
    return f.groupBy("part").agg(F.count("*").alias("n"), F.sum("target").alias("positives"), F.avg("target").alias("rate"), F.count("mean_amount").alias("known_amount"), F.count("closed").alias("known_closed"))


@query(
    "constant_imputation",
    f"with {P.FEATURES_SQL}, f as (select coalesce(closed, 0) as closed, coalesce(mean_amount, 0) as amount, coalesce(case when c_nationkey % 4 <> 0 then cast(c_nationkey as varchar) end, 'unknown') as nation from feats) select nation, count(*) as n, sum(closed) as closed, sum(amount) as amount from f group by nation",
    "nation, n",
    "closed, amount",
    3,
)
def constant_imputation(spark, d) -> DataFrame:
    """Missing numbers as 0 and missing names as a name of their own."""
    f = P.features(spark, d).select("closed", F.col("mean_amount").alias("amount"), F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey").cast("string")).alias("nation"))
    return f.fillna(0.0, ["closed", "amount"]).fillna("unknown", ["nation"]).groupBy("nation").agg(F.count("*").alias("n"), F.sum("closed").alias("closed"), F.sum("amount").alias("amount"))


@query(
    "naive_baselines",
    f"""with {P.TARGET_SQL}, r as (select avg(target) as rate from clients), p as (select target, rate, cast({P.uniform_sql('c_custkey', seed=21)} < rate as integer) as stratified, cast({P.uniform_sql('c_custkey', seed=22)} < 0.5 as integer) as even,
        cast(rate >= 0.5 as integer) as frequent from clients, r), l as (select 'most_frequent' as baseline, target, frequent as hit from p union all select 'stratified', target, stratified from p union all select 'uniform', target, even from p)
        select baseline, count(*) as n, avg(cast(target = hit as integer)) as accuracy, sum(hit) as called, sum(hit * target) as found from l group by baseline""",
    "baseline, n, called, found",
    "accuracy",
)
def naive_baselines(spark, d) -> DataFrame:
    """Predictions without features: the most frequent class, draws by its share, even draws."""
    c = P.clients(spark, d).select("c_custkey", "target")
    p = c.crossJoin(c.agg(F.avg("target").alias("rate")))
    calls = F.array(
        F.struct(F.lit("most_frequent").alias("baseline"), (F.col("rate") >= 0.5).cast("int").alias("hit")),
        F.struct(F.lit("stratified").alias("baseline"), (C.uniform("c_custkey", seed=21) < F.col("rate")).cast("int").alias("hit")),
        F.struct(F.lit("uniform").alias("baseline"), (C.uniform("c_custkey", seed=22) < 0.5).cast("int").alias("hit")),
    )
    rows = p.select("target", F.explode(calls).alias("c")).select("target", "c.*")
    return rows.groupBy("baseline").agg(F.count("*").alias("n"), F.avg((F.col("target") == F.col("hit")).cast("int")).alias("accuracy"), F.sum("hit").alias("called"), F.sum(F.col("hit") * F.col("target")).alias("found"))


@query(
    "fold_summary",
    f"with {P.BLOCKS_SQL}, m as (select model, count(*) as n, avg(score) as mean, stddev_pop(score) as sd from blocks group by model), b as (select *, max(mean) over () as best from m) select model, n, mean, sd, 2 * sd / sqrt(n) as margin, best - mean as gap, best - mean <= 2 * sd / sqrt(n) as within from b",
    "model, n, within",
    "mean, sd, margin, gap",
)
def fold_summary(spark, d) -> DataFrame:
    """Mean and deviation of each model over its folds, and whether it is within two standard errors of the best."""
    m = P.blocks(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    margin, gap = 2 * F.col("sd") / F.sqrt("n"), F.col("best") - F.col("mean")
    return m.crossJoin(m.agg(F.max("mean").alias("best"))).select("model", "n", "mean", "sd", margin.alias("margin"), gap.alias("gap"), (gap <= margin).alias("within"))


@query(
    "step_differences",
    "with m as (select strftime(cast(o_orderdate as date), '%Y-%m') as month, count(*) as n, avg(o_totalprice) as mean, stddev_pop(o_totalprice) / sqrt(count(*)) as se from orders group by 1), l as (select *, mean - lag(mean) over (order by month) as step from m) select month, n, mean, step, coalesce(abs(step) > 2 * se, false) as beyond from l",
    "month, n, beyond",
    "mean, step",
    4,
)
def step_differences(spark, d) -> DataFrame:
    """Change of each month's mean from the month before, and whether it is over two standard errors."""
    o = table(spark, d, "orders").select(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM").alias("month"), "o_totalprice")
    m = o.groupBy("month").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), (F.stddev_pop("o_totalprice") / F.sqrt(F.count("*"))).alias("se"))
    step = F.col("mean") - F.lag("mean").over(Window.orderBy("month"))  # a row for each month
    return m.withColumn("step", step).select("month", "n", "mean", "step", F.coalesce(F.abs("step") > 2 * F.col("se"), F.lit(False)).alias("beyond"))


@query(
    "redundancy",
    f"with {P.FEATURES_SQL} select " + "unnest(['mean_amount', 'max_amount', 'n_orders']) as variable, unnest([" + ", ".join(f"greatest(abs(corr({c}, total_amount)), abs(corr({c}, mean_days)))" for c in ("mean_amount", "max_amount", "n_orders")) + "]) as strongest from feats",
    "variable",
    "strongest",
)
def redundancy(spark, d) -> DataFrame:
    """Largest absolute correlation of each variable with two named scores."""
    names, scores = ["mean_amount", "max_amount", "n_orders"], ["total_amount", "mean_days"]
    wide = P.features(spark, d).agg(*(F.greatest(*(F.abs(F.corr(c, s)) for s in scores)).alias(c) for c in names))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("strongest")) for c in names))).alias("x")).select("x.*")


@query(
    "combined_p",
    f"with {P.BLOCKS_SQL}, p as (select model, {P.uniform_sql('block', 'model', seed=9)} as p from blocks) select model, count(*) as n, -2 * sum(ln(greatest(p, 1e-12))) as fisher, 2 * count(*) as df, least(min(p) * count(*), 1) as holm_least from p group by model",
    "model, n, df",
    "fisher, holm_least",
    4,
)
def combined_p(spark, d) -> DataFrame:
    """Fisher's statistic of block p-values, and the smallest after Holm's adjustment."""
    p = P.blocks(spark, d).select("model", C.uniform("block", "model", seed=9).alias("p"))
    return p.groupBy("model").agg(F.count("*").alias("n"), (-2 * F.sum(F.log(F.greatest("p", F.lit(1e-12))))).alias("fisher"), (2 * F.count("*")).alias("df"), F.least(F.min("p") * F.count("*"), F.lit(1.0)).alias("holm_least"))


@query(
    "independence",
    """with t as (select o_orderpriority as a, o_orderstatus as b, cast(count(*) as double) as n from orders group by 1, 2), ra as (select a, sum(n) as na from t group by a), rb as (select b, sum(n) as nb from t group by b), w as (select sum(n) as all_n from t),
       e as (select coalesce(n, 0) as n, na * nb / all_n as e from ra cross join rb cross join w left join t using (a, b)) select sum(pow(n - e, 2) / e) as chi2, (select (count(distinct a) - 1) * (count(distinct b) - 1) from t) as df from e""",
    "df",
    "chi2",
)
def independence(spark, d) -> DataFrame:
    """Chi-square of independence of two categories, from their cell counts."""
    t = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count("*").cast("double").alias("n"))
    a, b = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    cells = a.crossJoin(b).crossJoin(t.agg(F.sum("n").alias("all_n"))).join(t, ["a", "b"], "left")  # levels of two categories
    e = F.col("na") * F.col("nb") / F.col("all_n")
    found = cells.agg(F.sum(F.pow(F.coalesce("n", F.lit(0.0)) - e, 2) / e).alias("chi2"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("df"))
    return found


@query(
    "autocorrelations",
    f"with {P.ERRORS_SQL}, c as (select row, e1 - avg(e1) over () as x from errors), l as (select x, " + ", ".join(f"lag(x, {k}) over (order by row) as l{k}" for k in range(1, 41))
    + " from c) select unnest(range(1, 41)) as lag, unnest([" + ", ".join(f"sum(x * l{k}) / sum(x * x)" for k in range(1, 41)) + "]) as r from l",
    "lag",
    "r",
)
def autocorrelations(spark, d) -> DataFrame:
    return inference.autocorrelations(P.errors(spark, d).select("row", F.col("e1").alias("x")), 40).select(F.col("lag").cast("long").alias("lag"), "r")


@query(
    "residual_bins",
    f"with {P.ERRORS_SQL}, b as (select *, ntile(20) over (order by y, row) as bin from errors) select bin, count(*) as n, avg(e1) as mean_residual, avg(y) as mean_fitted from b group by bin",
    "bin, n",
    "mean_residual, mean_fitted",
)
def residual_bins(spark, d) -> DataFrame:
    """Mean residual and fitted value over twenty bins of equally many rows."""
    rows = order.equal_count_bins(P.errors(spark, d), 20, F.col("y"), F.col("row"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("e1").alias("mean_residual"), F.avg("y").alias("mean_fitted"))


@query(
    "density_grid",
    f"with {P.ERRORS_SQL} select cast(floor(y * 20) as integer) as col, cast(floor((e1 + 0.5) * 20) as integer) as line, count(*) as n from errors group by 1, 2",
    "col, line, n",
)
def density_grid(spark, d) -> DataFrame:
    """Counts of fitted value by residual over a grid of twenty by twenty."""
    return P.errors(spark, d).groupBy(F.floor(F.col("y") * 20).cast("int").alias("col"), F.floor((F.col("e1") + 0.5) * 20).cast("int").alias("line")).agg(F.count("*").alias("n"))


@query(
    "box_figures",
    "with q as (select o_orderpriority as grp, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as median, quantile_cont(o_totalprice, 0.75) as q3 from orders group by 1) select grp, q1, median, q3, min(o_totalprice) filter (o_totalprice >= q1 - 1.5 * (q3 - q1)) as low, max(o_totalprice) filter (o_totalprice <= q3 + 1.5 * (q3 - q1)) as high from orders join q on grp = o_orderpriority group by all",
    "grp",
    "q1, median, q3, low, high",
    4,
)
def box_figures(spark, d) -> DataFrame:
    """Quartiles and whiskers of each group; points outside the whiskers aren't shown."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("x"))
    q = quantiles.wide(o, "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["grp"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return o.join(q, "grp").groupBy("grp", "q1", "median", "q3").agg(F.min(F.when(F.col("x") >= F.col("q1") - reach, F.col("x"))).alias("low"), F.max(F.when(F.col("x") <= F.col("q3") + reach, F.col("x"))).alias("high"))


@query(
    "coverage_by_part",
    f"with {P.FEATURES_SQL}, l as (" + " union all ".join(f"select '{c}' as variable, u < 0.8 as dev, {c} is not null as known from feats" for c in P.FEATURES) + ") select variable, avg(cast(known as integer)) filter (dev) as dev_coverage, avg(cast(known as integer)) filter (not dev) as test_coverage from l group by variable",
    "variable",
    "dev_coverage, test_coverage",
)
def coverage_by_part(spark, d) -> DataFrame:
    """Coverage of each variable in the development and the test part."""
    long = screening.long_form(P.features(spark, d), P.FEATURES, "u").withColumn("known", F.col("value").isNotNull().cast("int"))
    return long.groupBy("variable").agg(F.avg(F.when(F.col("u") < 0.8, F.col("known"))).alias("dev_coverage"), F.avg(F.when(F.col("u") >= 0.8, F.col("known"))).alias("test_coverage"))


@query(
    "drop_duplicates",
    "select o_custkey, o_orderstatus, min(o_orderkey) as first_key from orders group by 1, 2",
    "o_custkey, o_orderstatus, first_key",
)
def drop_duplicates(spark, d) -> DataFrame:
    """One row of each customer and status: the one of the smallest key."""
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("first_key"))


def _index(spark, d):
    """Index of the vectors, and its recall of five neighbours by probes for a sample of 100 of them (those of the smallest hash)."""
    from gneiss.operators.index import VectorIndex

    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    found = VectorIndex(points)
    sample = points.orderBy(F.xxhash64("id", F.lit("recall")), "id").limit(100)
    return points, found, found.probes_for(sample, 5, RECALL)


@query("nearest_by_cells")
def nearest_by_cells(spark, d) -> DataFrame:
    """Five nearest vectors of each whose id is divisible by 100, looked for in as many cells as the measured recall asks for."""
    points, found, steps = _index(spark, d)
    probes = steps.where("enough").agg(F.min("probes")).first()[0] or 1
    return found.search(points.where("id % 100 = 0"), 5, probes).select("query", "point", "distance", F.col("nth").cast("long").alias("nth"))


@query("index_recall")
def index_recall(spark, d) -> DataFrame:
    """Recall of the index against exact neighbours, and the share of rows that a search reads, by number of cells."""
    return _index(spark, d)[2]
