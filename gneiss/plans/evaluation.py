"""Screening, metric and test queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import collapse, inference, metrics, screening
from gneiss.plans import frames as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, plain: str = "", doubles: str = "", digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


LONG_SQL = f"with {P.FEATURES_SQL}, long as (" + " union all ".join(f"select c_custkey, target, u, '{c}' as variable, cast({c} as double) as value from feats" for c in P.FEATURES) + ")"


@query(
    "missingness_test",
    LONG_SQL + """, t as (select variable, count(*) filter (value is null and target = 1) as a, count(*) filter (value is null and target = 0) as b, count(*) filter (value is not null and target = 1) as c,
        count(*) filter (value is not null and target = 0) as d from long group by variable), m as (select *, cast(a + b + c + d as double) as n, abs(cast(a as double) * d - cast(b as double) * c) as gap,
        cast(a + b as double) * (c + d) * (a + c) * (b + d) as margins from t)
        select variable, a, b, c, d, n * pow(greatest(gap - n / 2, 0), 2) / nullif(margins, 0) as chi2, a / nullif(a + b, 0) as rate_missing, c / nullif(c + d, 0) as rate_present from m""",
    "variable, a, b, c, d",
    "chi2, rate_missing, rate_present",
)
def missingness_test(spark, d) -> DataFrame:
    return screening.missingness(P.features(spark, d), P.FEATURES, "target")


@query(
    "auc_by_variable",
    LONG_SQL + """, r as (select *, rank() over (partition by variable order by value) + (count(*) over (partition by variable, value) - 1) / 2.0 as rk from long where value is not null),
        s as (select variable, count(*) as n, cast(sum(target) as double) as p, sum(case when target = 1 then rk else 0 end) as rs, corr(value, target) as corr from r group by variable)
        select s.variable, n, greatest((rs - p * (p + 1) / 2) / (p * (n - p)), 1 - (rs - p * (p + 1) / 2) / (p * (n - p))) as auc, corr, n / (select count(*) from feats) as coverage from s where n >= 100""",
    "variable, n",
    "auc, corr, coverage",
)
def auc_by_variable(spark, d) -> DataFrame:
    return screening.auc_by_variable(P.features(spark, d), P.FEATURES, "target")


@query(
    "separation",
    f"""with {P.FEATURES_SQL}, e as (select quantile_cont(mean_amount, [0, 0.2, 0.4, 0.6, 0.8, 1]) as q from feats),
        b as (select target, case when mean_amount is null then -1 when mean_amount <= q[2] then 0 when mean_amount <= q[3] then 1 when mean_amount <= q[4] then 2 when mean_amount <= q[5] then 3 else 4 end as bin from feats, e),
        g as (select bin, count(*) as n, sum(target) as p from b group by bin)
        select 'mean_amount' as variable, count(*) as bins, sum(n / (select sum(n) from g) * abs(p / n - (select sum(p) / sum(n) from g)) * 100) as separation from g""",
    "variable, bins",
    "separation",
)
def separation(spark, d) -> DataFrame:
    f = P.features(spark, d)
    return screening.separation(f, "mean_amount", "target", collapse.quantile_edges(f, "mean_amount", 5))


_PSI = LONG_SQL + """, known as (select variable, value, case when u < 0.7 then 'p' else 'q' end as side from long where value is not null),
    e as (select variable, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) filter (side = 'p'))) as edges from known group by variable),
    b as (select k.variable, side, len(list_filter(edges[2:len(edges) - 1], lambda x: x <= value)) as bin from known k join e using (variable)),
    n as (select variable, bin, count(*) filter (side = 'p') as p, count(*) filter (side = 'q') as q from b group by variable, bin),
    s as (select variable, greatest(p / sum(p) over w, 1e-6) as p, greatest(q / sum(q) over w, 1e-6) as q from n window w as (partition by variable))"""


@query("psi", _PSI + " select variable, sum((q - p) * ln(q / p)) as psi from s group by variable", "variable", "psi")
def psi(spark, d) -> DataFrame:
    f = P.features(spark, d)
    return screening.psi(f.where("u < 0.7"), f.where("u >= 0.7"), P.FEATURES)


_KS = LONG_SQL + """, c as (select variable, value, count(*) filter (u < 0.7) as a, count(*) filter (u >= 0.7) as b from long where value is not null group by variable, value),
    g as (select variable, abs(sum(a) over w / sum(a) over v - sum(b) over w / sum(b) over v) as gap from c window w as (partition by variable order by value), v as (partition by variable))"""


@query("ks", _KS + " select variable, max(gap) as ks from g group by variable", "variable", "ks")
def ks(spark, d) -> DataFrame:
    f = P.features(spark, d)
    return screening.ks(f.where("u < 0.7"), f.where("u >= 0.7"), P.FEATURES)


@query(
    "stability_exclusions",
    _PSI + """, ps as (select variable, sum((q - p) * ln(q / p)) as psi from s group by variable), c2 as (select variable, value, count(*) filter (u < 0.7) as a, count(*) filter (u >= 0.7) as b from long where value is not null group by variable, value),
    g as (select variable, abs(sum(a) over w / sum(a) over v - sum(b) over w / sum(b) over v) as gap from c2 window w as (partition by variable order by value), v as (partition by variable)), k as (select variable, max(gap) as ks from g group by variable),
    cov as (select variable, avg(cast(value is not null as integer)) filter (u < 0.7) as cp, avg(cast(value is not null as integer)) filter (u >= 0.7) as cq from long group by variable)
    select variable, psi > 0.25 as drifts, ks > 0.1 as shifts, least(cp, cq) < 0.85 as sparse, abs(cp - cq) > 0.1 as uneven, psi > 0.25 or ks > 0.1 or least(cp, cq) < 0.85 or abs(cp - cq) > 0.1 as excluded from ps join k using (variable) join cov using (variable)""",
    "variable, drifts, shifts, sparse, uneven, excluded",
)
def stability_exclusions(spark, d) -> DataFrame:
    f = P.features(spark, d)
    a, b = f.where("u < 0.7"), f.where("u >= 0.7")
    cover = lambda df, name: screening.long_form(df, P.FEATURES).groupBy("variable").agg(F.avg(F.col("value").isNotNull().cast("int")).alias(name))
    t = screening.psi(a, b, P.FEATURES).join(screening.ks(a, b, P.FEATURES), "variable").join(cover(a, "cp"), "variable").join(cover(b, "cq"), "variable")
    reasons = {"drifts": F.col("psi") > 0.25, "shifts": F.col("ks") > 0.1, "sparse": F.least("cp", "cq") < 0.85, "uneven": F.abs(F.col("cp") - F.col("cq")) > 0.1}
    return t.select("variable", *(c.alias(n) for n, c in reasons.items())).withColumn("excluded", F.expr(" or ".join(reasons)))


_PAIRS = [(a, b) for i, a in enumerate(P.FEATURES) for b in P.FEATURES[i + 1 :]]
_CORR = f"with {P.FEATURES_SQL}, r as (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r, count(*) filter ({a} is not null and {b} is not null) as n from feats" for a, b in _PAIRS) + ")"


@query("correlations", _CORR + " select * from r", "a, b, n", "r")
def correlations(spark, d) -> DataFrame:
    return screening.correlations(P.features(spark, d), P.FEATURES)


@query(
    "equivalence_groups",
    _CORR.replace("with clients", "with recursive clients", 1) + """, e as (select a, b from r where abs(r) > 0.4 union select b, a from r where abs(r) > 0.4), walk(node, reach) as (select a, a from e union select w.node, e.b from walk w join e on w.reach = e.a),
        comp as (select node as variable, min(reach) as component from walk group by node), cov as (""" + " union all ".join(f"select '{c}' as variable, count({c}) / count(*) as coverage from feats" for c in P.FEATURES) + """)
        select variable, component, first_value(variable) over (partition by component order by coverage desc, length(variable), variable) as survivor from comp join cov using (variable)""",
    "variable, component, survivor",
)
def equivalence_groups(spark, d) -> DataFrame:
    f = P.features(spark, d)
    cover = screening.long_form(f, P.FEATURES).groupBy("variable").agg(F.avg(F.col("value").isNotNull().cast("int")).alias("coverage"))
    return screening.equivalence_groups(screening.correlations(f, P.FEATURES), cover, 0.4)


_RANK = f"""with {P.SCORES_SQL}, v as (select s, count(*) as n, sum(y) as pos from scored group by s), t as (select s, n, pos, sum(pos) over w as tp, sum(n - pos) over w as fp, sum(pos) over () as p, sum(n) over () as all_n
    from v window w as (order by s desc))"""


@query(
    "ranking_metrics",
    _RANK + " select cast(max(all_n) as bigint) as n, cast(max(p) as bigint) as p, sum((n - pos) * (tp - pos + pos / 2)) / (max(p) * (max(all_n) - max(p))) as auc, sum(pos * tp / (tp + fp)) / max(p) as ap from t",
    "n, p",
    "auc, ap",
)
def ranking_metrics(spark, d) -> DataFrame:
    return metrics.ranking(P.scores(spark, d))


@query(
    "ranking_by_fold",
    f"""with {P.SCORES_SQL}, r as (select *, rank() over (partition by fold order by s) + (count(*) over (partition by fold, s) - 1) / 2.0 as rk from scored)
        select fold, count(*) as n, sum(y) as p, (sum(y * rk) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) as auc from r group by fold""",
    "fold, n, p",
    "auc",
)
def ranking_by_fold(spark, d) -> DataFrame:
    return metrics.ranking(P.scores(spark, d), "fold").select("fold", "n", "p", "auc")


@query(
    "confusion",
    f"""with {P.SCORES_SQL}, c as (select count(*) filter (y = 1 and s >= 0.5) as tp, count(*) filter (y = 0 and s >= 0.5) as fp, count(*) filter (y = 1 and s < 0.5) as fn, count(*) filter (y = 0 and s < 0.5) as tn from scored)
        select *, (tp + tn) / (tp + fp + fn + tn) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(tn / nullif(tn + fp, 0), 0) as specificity,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from c""",
    "tp, fp, fn, tn",
    "accuracy, precision, recall, specificity, f1",
)
def confusion(spark, d) -> DataFrame:
    return metrics.confusion(P.scores(spark, d), 0.5)


@query(
    "best_thresholds",
    _RANK + """, c as (select s, 10 * (p - tp) + fp as cost, tp / p - fp / (all_n - p) as j, 2 * tp / (tp + fp + p) as f1, 10 * p as none from t)
        select (select case when cost <= none then s end from c order by cost, s desc limit 1) as cost_threshold, (select least(min(cost), max(none)) from c) as cost, (select s from c order by j desc, s desc limit 1) as youden_threshold,
        (select max(j) from c) as youden, (select s from c order by f1 desc, s desc limit 1) as f1_threshold, (select max(f1) from c) as f1""",
    "",
    "cost_threshold, cost, youden_threshold, youden, f1_threshold, f1",
)
def best_thresholds(spark, d) -> DataFrame:
    return metrics.best_thresholds(P.scores(spark, d))


@query("curves", _RANK + " select s, tp / p as tpr, fp / (all_n - p) as fpr, tp / (tp + fp) as precision from t", "", "s, tpr, fpr, precision")
def curves(spark, d) -> DataFrame:
    return metrics.curves(P.scores(spark, d))


_EDGES = "[" + ", ".join(f"cast({i} as double) / 15" for i in range(1, 15)) + "]"


@query(
    "calibration",
    f"with {P.SCORES_SQL} select cast(len(list_filter({_EDGES}, lambda e: e <= s)) as integer) as bin, count(*) as n, avg(s) as mean_score, avg(y) as rate from scored group by 1",
    "bin, n",
    "mean_score, rate",
)
def calibration(spark, d) -> DataFrame:
    return metrics.calibration(P.scores(spark, d))


@query(
    "calibration_error",
    f"with {P.SCORES_SQL}, b as (select *, ntile(15) over (order by s, row) as bin from scored), t as (select count(*) as n, abs(avg(s) - avg(y)) as gap from b group by bin) select sum(n * gap) / sum(n) as ece from t",
    "",
    "ece",
)
def calibration_error(spark, d) -> DataFrame:
    return metrics.expected_error(metrics.calibration_equal_count(P.scores(spark, d), "row"))


@query(
    "regression_metrics",
    f"with {P.SCORES_SQL} select sqrt(avg(pow(y - s, 2))) as rmse, avg(abs(y - s)) as mae, 1 - avg(pow(y - s, 2)) / var_pop(y) as r2, avg(pow(least(greatest(s, 0), 1) - y, 2)) as brier from scored",
    "",
    "rmse, mae, r2, brier",
)
def regression_metrics(spark, d) -> DataFrame:
    return metrics.regression(P.scores(spark, d))


@query(
    "adjusted_p",
    f"""with {P.BLOCKS_SQL}, p as (select cast(block as varchar) || model as name, {P.uniform_sql('block', 'model', seed=8)} / 20 as p from blocks), r as (select *, row_number() over (order by p, name) as i, count(*) over () as m from p)
        select name, p, least(max((m - i + 1) * p) over (order by i), 1) as holm, least(min(m * p / i) over (order by i desc), 1) as bh from r""",
    "name",
    "p, holm, bh",
)
def adjusted_p(spark, d) -> DataFrame:
    return inference.adjust_p(P.blocks(spark, d).select(F.concat(F.col("block").cast("string"), "model").alias("name"), (C.uniform("block", "model", seed=8) / 20).alias("p")))


@query(
    "friedman",
    f"""with {P.BLOCKS_SQL}, r as (select *, rank() over (partition by block order by score desc) + (count(*) over (partition by block, score) - 1) / 2.0 as rk from blocks), s as (select sum(q) as ssq from (select pow(sum(rk), 2) as q from r group by model)),
        t as (select sum(pow(c, 3) - c) as ties from (select count(*) as c from r group by block, score)), z as (select count(distinct block) as n, count(distinct model) as k from blocks),
        f as (select n, k, (12.0 / (n * k * (k + 1)) * ssq - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) as chi2 from z, s, t) select n, k, chi2, (n - 1) * chi2 / (n * (k - 1) - chi2) as f from f""",
    "n, k",
    "chi2, f",
)
def friedman(spark, d) -> DataFrame:
    return inference.friedman(P.blocks(spark, d))


@query(
    "newey_west",
    f"with {P.ERRORS_SQL}, c as (select row, e1 - avg(e1) over () as x from errors), l as (select *, " + ", ".join(f"lag(x, {k}) over (order by row) as l{k}" for k in range(1, 5))
    + " from c) select count(*) as n, avg(x * x) + " + " + ".join(f"2 * (1 - {k} / 5.0) * sum(x * l{k}) / count(*)" for k in range(1, 5)) + " as variance from l",
    "n",
    "variance",
    9,
)
def newey_west(spark, d) -> DataFrame:
    return inference.newey_west(P.errors(spark, d).select("row", F.col("e1").alias("x")), 4)


@query(
    "delong",
    f"""with {P.SCORES_SQL}, pos as (select s as a, s2 as b, row from scored where y = 1), neg as (select s as a, s2 as b, row from scored where y = 0),
        x as (select p.row as pr, n.row as nr, case when p.a > n.a then 1.0 when p.a = n.a then 0.5 else 0 end as h1, case when p.b > n.b then 1.0 when p.b = n.b then 0.5 else 0 end as h2 from pos p, neg n),
        v10 as (select avg(h1) - avg(h2) as d from x group by pr), v01 as (select avg(h1) - avg(h2) as d from x group by nr), z as (select (select var_samp(d) / count(*) from v10) + (select var_samp(d) / count(*) from v01) as variance)
        select avg(h1) as auc1, avg(h2) as auc2, max(variance) as variance, (avg(h1) - avg(h2)) / sqrt(max(variance)) as z from x, z""",
    "",
    "auc1, auc2, variance, z",
)
def delong(spark, d) -> DataFrame:
    return inference.delong(P.scores(spark, d).select("y", F.col("s").alias("s1"), "s2"))


@query(
    "cliff_delta",
    f"with {P.SCORES_SQL} select (count(*) filter (p.s > n.s) - count(*) filter (p.s < n.s)) / count(*) as delta from scored p, scored n where p.y = 1 and n.y = 0",
    "",
    "delta",
)
def cliff_delta(spark, d) -> DataFrame:
    x = P.scores(spark, d).withColumnRenamed("s", "x")
    return inference.cliff_delta(x.where("y = 1"), x.where("y = 0"))


@query("cohen_paired", f"with {P.SCORES_SQL} select avg(s - s2) as mean, stddev_samp(s - s2) as sd, count(*) as n, avg(s - s2) / stddev_samp(s - s2) as d from scored", "n", "mean, sd, d")
def cohen_paired(spark, d) -> DataFrame:
    return inference.cohen_paired(P.scores(spark, d).select(F.col("s").alias("a"), F.col("s2").alias("b")))


@query("diebold_mariano", f"with {P.ERRORS_SQL}, x as (select e1 * e1 - e2 * e2 as x from errors) select count(*) as n, avg(x) as mean, avg(x) / sqrt(var_pop(x) / count(*)) * sqrt((count(*) - 1) / count(*)) as dm from x", "n", "mean, dm")
def diebold_mariano(spark, d) -> DataFrame:
    return inference.diebold_mariano(P.errors(spark, d))


@query(
    "giacomini_white",
    f"""with {P.ERRORS_SQL}, x as (select row, e1 * e1 - e2 * e2 as x from errors), z as (select * from (select x, lag(x) over (order by row) as z from x) where z is not null),
        m as (select count(*) as n, avg(x) as m1, avg(x * z) as m2, avg(x * x) as s11, avg(x * x * z) as s12, avg(x * z * x * z) as s22 from z)
        select n, n * (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / (s11 * s22 - s12 * s12) as gw from m""",
    "n",
    "gw",
)
def giacomini_white(spark, d) -> DataFrame:
    return inference.giacomini_white(P.errors(spark, d))


@query("clark_west", f"with {P.ERRORS_SQL}, f as (select row, pow(y - (e1 + 0.5), 2) - (pow(y - (e2 + 0.5), 2) - pow(e1 - e2, 2)) as f from errors), c as (select row, f, f - avg(f) over () as x from f), l as (select *, " + ", ".join(f"lag(x, {k}) over (order by row) as l{k}" for k in range(1, 5))
    + " from c) select count(*) as n, avg(f) as mean, avg(f) / sqrt((avg(x * x) + " + " + ".join(f"2 * (1 - {k} / 5.0) * sum(x * l{k}) / count(*)" for k in range(1, 5)) + ") / count(*)) as cw from l", "n", "mean, cw")
def clark_west(spark, d) -> DataFrame:
    return inference.clark_west(P.errors(spark, d).select("row", "y", (F.col("e1") + 0.5).alias("restricted"), (F.col("e2") + 0.5).alias("general")), 4)


@query(
    "wilcoxon",
    f"""with {P.SCORES_SQL}, d as (select abs(round(s - s2, 2)) as m, sign(round(s - s2, 2)) as g from scored), r as (select *, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2.0 as rk from d),
        t as (select count(*) as n, count(*) filter (g = 0) as zeros, sum(case when g > 0 then rk when g = 0 then rk / 2 else 0 end) as up, sum(case when g < 0 then rk when g = 0 then rk / 2 else 0 end) as down from r)
        select n, zeros, least(up, down) as w, up - down as balance from t""",
    "n, zeros",
    "w, balance",
)
def wilcoxon(spark, d) -> DataFrame:
    return inference.wilcoxon(P.scores(spark, d).select(F.round(F.col("s") - F.col("s2"), 2).alias("a"), F.lit(0.0).alias("b")))


@query(
    "ljung_box",
    f"with {P.ERRORS_SQL}, c as (select row, e1 - avg(e1) over () as x from errors), l as (select *, " + ", ".join(f"lag(x, {k}) over (order by row) as l{k}" for k in range(1, 11))
    + " from c) select count(*) as n, count(*) * (count(*) + 2) * (" + " + ".join(f"pow(sum(x * l{k}) / sum(x * x), 2) / (count(*) - {k})" for k in range(1, 11)) + ") as q from l",
    "n",
    "q",
)
def ljung_box(spark, d) -> DataFrame:
    return inference.ljung_box(P.errors(spark, d).select("row", F.col("e1").alias("x")), 10)


@query(
    "jarque_bera",
    f"""with {P.ERRORS_SQL}, m as (select avg(e1) as mu from errors), t as (select count(*) as n, avg(pow(e1 - mu, 2)) as m2, avg(pow(e1 - mu, 3)) as m3, avg(pow(e1 - mu, 4)) as m4 from errors, m)
        select n, m3 / pow(m2, 1.5) as skew, m4 / (m2 * m2) - 3 as kurtosis, n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) as jb from t""",
    "n",
    "skew, kurtosis, jb",
)
def jarque_bera(spark, d) -> DataFrame:
    return inference.jarque_bera(P.errors(spark, d).select(F.col("e1").alias("x")))


@query("scaling_exponent", "select regr_slope(ln(p_retailprice), ln(p_size)) as exponent, regr_intercept(ln(p_retailprice), ln(p_size)) as intercept, regr_r2(ln(p_retailprice), ln(p_size)) as r2 from part", "", "exponent, intercept, r2")
def scaling_exponent(spark, d) -> DataFrame:
    from gneiss.sources.storage import table

    return inference.scaling_exponent(table(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_retailprice").alias("time")))
