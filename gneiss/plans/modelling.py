"""Nested studies, recalibration, residual tests, kernels and explanations, with their SQL twins."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import collapse, inference, learners, metrics, modelling, resampling, screening
from gneiss.plans import frames as P
from gneiss.plans.learning import NUMBERS, _prepared, _vectors
from gneiss.sources.storage import materialize, shared_dir, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Sets of columns that a nested study chooses from.
CANDIDATES = {"activity": ["n_orders", "closed"], "all": NUMBERS, "amount": ["mean_amount"]}


def query(name: str, sql: str | None = None, plain: str = "", doubles: str = "", digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        if sql:
            ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


def _stats_sql(y: str) -> str:
    per = lambda k: ", ".join(f"avg({c}) filter ({y} = {k}) as m{k}_{c}, var_pop({c}) filter ({y} = {k}) as v{k}_{c}" for c in NUMBERS)
    return f"count(*) filter ({y} = 1) as n1, count(*) filter ({y} = 0) as n0, {per(0)}, {per(1)}, {', '.join(f'var_pop({c}) as w_{c}' for c in NUMBERS)}"


def _odds_sql(columns: list[str]) -> str:
    extra = f"1e-9 * {'greatest(' + ', '.join('w_' + c for c in columns) + ')' if len(columns) > 1 else 'w_' + columns[0]}"
    term = lambda k, c: f"(-0.5 * ln(v{k}_{c} + {extra}) - pow({c} - m{k}_{c}, 2) / (2 * (v{k}_{c} + {extra})))"
    return "ln(n1 / n0)" + "".join(f" + coalesce({term(1, c)} - {term(0, c)}, 0)" for c in columns)


def _study_sql(rows: str) -> str:
    """Tables ``best``, ``au``, ``th`` and ``cells`` of a nested study on the customers of ``rows``."""
    names = ", ".join(NUMBERS)
    return f"""{P.FEATURES_SQL}, cells as (select *, (row_number() over (partition by target order by {P.order_sql('c_custkey')}, c_custkey) - 1) % 15 as cell from feats where {rows}),
        fits as (select k, j from range(5) a(k), (select unnest([-1, 0, 1, 2]) as j) b),
        roles as (select target as y, {names}, k, j, cell % 5 as own, cell // 5 as deal from cells, fits),
        st as (select k, j, {_stats_sql('y')} from roles where own <> k and deal <> j group by k, j),
        sc as (select roles.*, st.* exclude (k, j) from roles join st using (k, j) where case when j = -1 then own = k else own <> k and deal = j end),
        lng as ({' union all '.join(f"select k, j, y, '{name}' as candidate, {_odds_sql(own)} as s from sc" for name, own in CANDIDATES.items())}),
        rk as (select *, rank() over (partition by k, j, candidate order by s) + (count(*) over (partition by k, j, candidate, s) - 1) / 2 as r from lng),
        au as (select k, j, candidate, (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) as auc from rk group by k, j, candidate),
        inn as (select k, candidate, avg(auc) as inner_auc from au where j >= 0 group by k, candidate),
        best as (select k, candidate, inner_auc from inn qualify row_number() over (partition by k order by inner_auc desc, candidate desc) = 1),
        pt as (select k, s, sum(y) as pos, count(*) as n from lng join best using (k, candidate) where j >= 0 group by k, s),
        cu as (select k, s, sum(pos) over w as tp, sum(n) over w as upto, sum(pos) over (partition by k) as p from pt window w as (partition by k order by s desc)),
        co as (select k, s, p, 10.0 * (p - tp) + (upto - tp) as cost from cu qualify row_number() over (partition by k order by 10.0 * (p - tp) + (upto - tp), s desc) = 1),
        th as (select k, case when cost <= 10.0 * p then s end as cost_threshold, least(cost, 10.0 * p) as cost from co)"""


@query(
    "nested_study",
    f"with {_study_sql('true')} select best.k as outer_fold, best.candidate, inner_auc, auc as outer_auc, inner_auc - auc as optimism, cost_threshold, cost from best join au on au.k = best.k and au.candidate = best.candidate and j = -1 join th on th.k = best.k",
    "outer_fold, candidate",
    "inner_auc, outer_auc, optimism, cost_threshold, cost",
)
def nested_study(spark, d) -> DataFrame:
    """Columns chosen on inner folds, a threshold from inner scores, and the score on the outer fold."""
    return modelling.nested_study(P.features(spark, d), "c_custkey", "target", CANDIDATES)


@query(
    "final_evaluation",
    f"""with {_study_sql('u < 0.8')}, ch as (select candidate from best order by inner_auc desc, k limit 1), lm as (select coalesce(median(cost_threshold), 'infinity'::double) as t from th), fs as (select {_stats_sql('target')} from cells),
        te as (select target as y, case ch.candidate {' '.join(f"when '{name}' then {_odds_sql(own)}" for name, own in CANDIDATES.items())} end as s, ch.candidate from feats, fs, ch where u >= 0.8),
        tr as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as r, sum(y) over (order by s desc) as tp, count(*) over (order by s desc) as upto from te)
        select any_value(candidate) as candidate, count(*) as n, (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) as auc, sum(case when y = 1 then tp / upto end) / sum(y) as ap,
        count(*) filter (y = 1 and s >= t) as tp, count(*) filter (y = 0 and s >= t) as fp, count(*) filter (y = 1 and s < t) as fn, count(*) filter (y = 0 and s < t) as tn from tr, lm""",
    "candidate, n, tp, fp, fn, tn",
    "auc, ap",
)
def final_evaluation(spark, d) -> DataFrame:
    """The finalist refitted on the development rows and evaluated once on test rows."""
    f = P.features(spark, d)
    return modelling.final_evaluation(f.where("u < 0.8"), f.where("u >= 0.8"), "c_custkey", "target", CANDIDATES)


@query(
    "isotonic_recalibration",
    f"""with {P.SCORES_SQL}, g as (select k, s, count(*) as n, sum(y) as pos from scored, range(5) f(k) where fold <> k group by k, s), i as (select *, row_number() over (partition by k order by s) as i from g),
        su as (select a.k, a.i as lo, b.i as hi, sum(b.pos) over (partition by a.k, a.i order by b.i) / sum(b.n) over (partition by a.k, a.i order by b.i) as m from i a join i b on a.k = b.k and b.i >= a.i),
        lows as (select k, lo, hi, min(m) over (partition by k, lo order by hi desc) as m from su), v as (select i.k, i.s, max(lows.m) as v from i join lows on lows.k = i.k and lows.lo <= i.i and lows.hi = i.i group by i.k, i.s),
        q as (select row, y, fold, s, (select max(v.s) from v where v.k = fold and v.s <= scored.s) as a, (select min(v.s) from v where v.k = fold and v.s >= scored.s) as b from scored)
        select row, y, fold, case when q.a is null then vb.v when q.b is null or q.a = q.b then va.v else va.v + (vb.v - va.v) * (q.s - q.a) / (q.b - q.a) end as s from q left join v va on va.k = fold and va.s = q.a left join v vb on vb.k = fold and vb.s = q.b""",
    "row, y, fold",
    "s",
)
def isotonic_recalibration(spark, d) -> DataFrame:
    """Every fold's scores made monotone rates by the other folds."""
    return modelling.recalibrated_out_of_fold(P.scores(spark, d).select("row", "y", "fold", "s"), "isotonic")


@query("calibration_variants")
def calibration_variants(spark, d) -> DataFrame:
    """Brier score, calibration errors and AUC of raw, Platt and isotonic scores."""
    raw = P.scores(spark, d).select("row", "y", "fold", "s")
    out = []
    for name in ("raw", "platt", "isotonic"):
        s = raw if name == "raw" else materialize(modelling.recalibrated_out_of_fold(raw, name), "recalibrated")
        wide, even = (metrics.expected_error(t) for t in (metrics.calibration(s), metrics.calibration_equal_count(s, "row")))
        parts = metrics.regression(s).select("brier").crossJoin(wide.withColumnRenamed("ece", "ece_width")).crossJoin(even.withColumnRenamed("ece", "ece_count")).crossJoin(metrics.ranking(s).select("auc"))
        out.append(parts.select(F.lit(name).alias("variant"), "*"))
    return reduce(DataFrame.unionByName, out)


@query(
    "delong_interval",
    f"""with {P.SCORES_SQL}, n as (select avg(case when a.s > b.s then 1 when a.s = b.s then 0.5 else 0 end) as v from scored a join scored b on a.y = 1 and b.y = 0 group by a.row), m as (select avg(case when a.s > b.s then 1 when a.s = b.s then 0.5 else 0 end) as v from scored a join scored b on a.y = 1 and b.y = 0 group by b.row),
        t as (select (select avg(v) from n) as auc, sqrt((select var_samp(v) / count(*) from n) + (select var_samp(v) / count(*) from m)) as se) select auc, se, greatest(auc - 1.959963984540054 * se, 0) as low, least(auc + 1.959963984540054 * se, 1) as high from t""",
    "",
    "auc, se, low, high",
)
def delong_interval(spark, d) -> DataFrame:
    return modelling.delong_interval(P.scores(spark, d), "s")


@query(
    "normality",
    """with m as (select cast(count(*) as double) as n, avg(o_totalprice) as mu from orders), c as (select n, avg(pow(o_totalprice - mu, 2)) as m2, avg(pow(o_totalprice - mu, 3)) as m3, avg(pow(o_totalprice - mu, 4)) as m4 from orders, m group by n),
        g as (select n, m3 / pow(m2, 1.5) as g1, m4 / (m2 * m2) as b2 from c), a as (select *, g1 * sqrt((n + 1) * (n + 3) / 6 / (n - 2)) as y, -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) as w2,
        (b2 - 3 * (n - 1) / (n + 1)) * (n + 1) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 3) * (n + 5))) as x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as sb from g),
        b as (select *, 1 / sqrt(ln(sqrt(w2))) as delta, sqrt(2 / (w2 - 1)) as alpha, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) as aa from a),
        z as (select n, g1, b2 - 3 as excess, delta * ln(y / alpha + sqrt(pow(y / alpha, 2) + 1)) as z_skew, ((1 - 2 / (9 * aa)) - cbrt((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) as z_kurtosis from b)
        select *, z_skew * z_skew + z_kurtosis * z_kurtosis as k2 from z""",
    "",
    "n, g1, excess, z_skew, z_kurtosis, k2",
    5,
)
def normality(spark, d) -> DataFrame:
    return modelling.normality(table(spark, d, "orders").select(F.col("o_totalprice").alias("x")))


@query(
    "diebold_mariano_ahead",
    f"with {P.ERRORS_SQL}, x as (select row, abs(e1) - abs(e2) as x from errors), c as (select row, x - (select avg(x) from x) as x from x), l as (select x, lag(x, 1) over (order by row) as x1, lag(x, 2) over (order by row) as x2 from c), g as (select count(*) as n, (select avg(x) from x) as mean, (sum(x * x) + 2 * sum(x * x1) + 2 * sum(x * x2)) / count(*) / count(*) as v from l) select n, mean, case when v > 0 then mean / sqrt(v) * sqrt((n - 5 + 6.0 / n) / n) end as dm from g",
    "n",
    "mean, dm",
)
def diebold_mariano_ahead(spark, d) -> DataFrame:
    """Absolute losses, three steps ahead."""
    return inference.diebold_mariano(P.errors(spark, d), 3, 1)


@query(
    "cliff_label",
    f"with {P.TARGET_SQL}, v as (select target, c_acctbal from clients join customer using (c_custkey)), u as (select c_acctbal, count(*) filter (target = 1) as a, count(*) filter (target = 0) as b from v group by c_acctbal), w as (select *, sum(b) over (order by c_acctbal) - b as below, sum(b) over () as m, sum(a) over () as n from u), t as (select (sum(a * (2 * below + b)) - max(n) * max(m)) / (max(n) * max(m)) as delta from w) select delta, case when abs(delta) < 0.147 then 'negligible' when abs(delta) < 0.33 then 'small' when abs(delta) < 0.474 then 'medium' else 'large' end as label from t",
    "label",
    "delta",
)
def cliff_label(spark, d) -> DataFrame:
    """Effect size by its published limits (fixed values)."""
    v = P.clients(spark, d).select("c_custkey", "target").join(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x")), "c_custkey")
    size = F.abs("delta")
    label = F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")
    return inference.cliff_delta(v.where("target = 1"), v.where("target = 0")).withColumn("label", label)


@query(
    "local_cases",
    f"with {P.SCORES_SQL} select 'highest' as which, row, s from (select row, s from scored where y = 1 order by s desc, row limit 1) union all select 'lowest', row, s from (select row, s from scored where y = 1 order by s, row limit 1)",
    "which, row",
    "s",
)
def local_cases(spark, d) -> DataFrame:
    """The positives with the highest and the lowest score."""
    t = P.scores(spark, d).where("y = 1").agg(F.min(F.struct(-F.col("s"), "row", "s")).alias("highest"), F.min(F.struct("s", "row")).alias("lowest"))
    cells = F.array(*(F.struct(F.lit(n).alias("which"), F.col(f"{n}.row").alias("row"), F.col(f"{n}.s").alias("s")) for n in ("highest", "lowest")))
    return t.select(F.explode(cells).alias("c")).select("c.*")


@query(
    "class_density",
    f"with {P.SCORES_SQL}, h as (select y, count(*) as n, 1.06 * stddev_samp(s) * pow(count(*), -0.2) as h from scored group by y), g as (select i / 20.0 as spot from range(21) t(i)) select spot, scored.y, avg(exp(-pow((spot - s) / h, 2) / 2) / h / sqrt(2 * pi())) as density from scored join h using (y), g group by spot, scored.y",
    "y",
    "spot, density",
)
def class_density(spark, d) -> DataFrame:
    """Kernel density of the scores of each class on a grid of 21 points."""
    s = P.scores(spark, d).select("y", "s")
    width = s.groupBy("y").agg((1.06 * F.stddev("s") * F.pow(F.count("*"), F.lit(-0.2))).alias("h"))
    rows = s.join(width, "y").withColumn("spot", F.explode(F.array(*(F.lit(i / 20) for i in range(21)))))
    return rows.groupBy("spot", "y").agg(F.avg(F.exp(-F.pow((F.col("spot") - F.col("s")) / F.col("h"), 2) / 2) / F.col("h") / (2 * 3.141592653589793) ** 0.5).alias("density"))


@query(
    "time_projection",
    "with t as (select event_type as model, avg(value) as seconds, count(*) as n from events group by event_type) select model, n, seconds, 5 * (4 * 30 * 3 * seconds + 1.5 * seconds) / 3600 as hours from t",
    "model, n",
    "seconds, hours",
)
def time_projection(spark, d) -> DataFrame:
    """Hours of a study from the seconds of one evaluation: 5 outer folds, 4 searches of 30 evaluations on 3 inner folds, one refit on half as many rows again."""
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("seconds"), F.count("*").alias("n"))
    return t.withColumn("hours", 5 * (4 * 30 * 3 * F.col("seconds") + 1.5 * F.col("seconds")) / 3600)


@query(
    "narrow_types",
    " union all ".join(
        f"select '{c}' as name, case when min({c}) >= -128 and max({c}) <= 127 then 'tinyint' when min({c}) >= -32768 and max({c}) <= 32767 then 'smallint' when min({c}) >= -2147483648 and max({c}) <= 2147483647 then 'int' else 'bigint' end as type, cast(sum({c}) as bigint) as total from lineitem"
        for c in ("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey")
    ),
    "name, type, total",
)
def narrow_types(spark, d) -> DataFrame:
    """Whole-number columns cast to their narrowest types: the type, and the sum of the cast column."""
    lines = table(spark, d, "lineitem")
    names = ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"]
    narrow = collapse.narrowed(lines.select(*names))
    sums = narrow.agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in names))
    types = dict(narrow.dtypes)
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(types[c]).alias("type"), F.col(c).alias("total")) for c in names))).alias("c")).select("c.*")


@query("prediction_store", f"with {P.SCORES_SQL} select row, fold, y, s from scored", "row, fold, y", "s")
def prediction_store(spark, d) -> DataFrame:
    """Predictions written by fold and read back as one table."""
    path, p = f"{shared_dir(spark)}/predictions-{uuid.uuid4().hex}", P.scores(spark, d).select("row", "fold", "y", "s")
    p.write.partitionBy("fold").parquet(path)
    return spark.read.schema(p.schema).parquet(path).select("row", "fold", "y", "s")


@query(
    "knn_weighted_votes",
    """with q as (select vec_id as id, embedding as x from embeddings where vec_id % 100 = 0), d as (select id, cast(label = 0 as integer) as y, list_distance(cast(x as double[]), cast(embedding as double[])) as distance, vec_id from q, embeddings where vec_id % 100 <> 0),
       n as (select *, row_number() over (partition by id order by distance, vec_id) as nth from d) select id, sum(case when y = 1 then 9.0 else 0 end) / sum(case when y = 1 then 9.0 else 1 end) as s from n where nth <= 15 group by id""",
    "id",
    "s",
)
def knn_weighted_votes(spark, d) -> DataFrame:
    """Neighbours of the rare class weigh nine times as much."""
    v = _vectors(spark, d)
    return learners.knn_scores(v.where("id % 100 <> 0"), v.where("id % 100 = 0"), 15, positive=9.0)


@query("reduced_neighbours", digits=4)
def reduced_neighbours(spark, d) -> DataFrame:
    """Scores of the nearest neighbours among the first ten principal components."""
    v = _vectors(spark, d)
    train = v.where("id % 100 <> 0")
    both = materialize(modelling.reduced(train, v, 10), "components")
    return learners.knn_scores(both.where("id % 100 <> 0"), both.where("id % 100 = 0"), 15, "distance")


@query("kernel_svm")
def kernel_svm(spark, d) -> DataFrame:
    """AUC of a linear support vector machine on Nystroem features of 50 landmarks."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    v = _vectors(spark, d)
    base = modelling.landmarks(v, 50)
    rows = materialize(modelling.kernel_features(v, base, 0.5), "kernel").withColumn("features", array_to_vector("embedding")).drop("embedding")
    model = LinearSVC(labelCol="y", maxIter=20, regParam=0.001, standardization=False).fit(rows.where("id % 5 <> 0"))
    return metrics.ranking(learners.scores(model, rows.where("id % 5 = 0")))


@query("vector_regression", digits=4)
def vector_regression(spark, d) -> DataFrame:
    """Weights of a linear support vector regression, the intercept as "1"."""
    train, _ = _prepared(spark, d)
    train = materialize(train.select(*NUMBERS, F.col("mean_amount").alias("y"), "u"), "rows").withColumn("y", 0.5 * F.col("n_orders") - 0.25 * F.col("closed") + F.col("u"))
    w = modelling.support_vector_regression(train, NUMBERS, "y", cost=1.0, epsilon=0.1, tolerance=1e-3)
    return spark.createDataFrame([(n, float(b)) for n, b in zip([*NUMBERS, "1"], w, strict=True)], "feature string, weight double")


@query("boosting_early_stop")
def boosting_early_stop(spark, d) -> DataFrame:
    """Boosting that ends when a stratified tenth of the training rows gains no more: trees kept, and AUC on held-out rows."""
    from gneiss.operators.splits import stratified

    train, test = _prepared(spark, d)
    dealt = stratified(train, "c_custkey", "y", {"fit": 0.9, "stop": 0.1}).withColumn("stop", F.col("part") == "stop")
    model = learners.learner("boosting", NUMBERS, "y", maxIter=20, maxDepth=3, validationIndicatorCol="stop").fit(dealt)
    return metrics.ranking(learners.scores(model, test)).withColumn("trees", F.lit(model.stages[-1].getNumTrees))


def _coefficients(spark, d) -> tuple[DataFrame, DataFrame, list[float]]:
    train, _ = _prepared(spark, d)
    train = materialize(train, "prepared")
    model = learners.learner("logistic_l1", NUMBERS, "y", regParam=0.002, maxIter=200, tol=1e-9).fit(train).stages[-1]
    weights = [float(w) for w in model.coefficients]
    return train, spark.createDataFrame(list(zip(NUMBERS, weights, strict=True)), "feature string, weight double"), [*weights, float(model.intercept)]


@query("model_coefficients", digits=4)
def model_coefficients(spark, d) -> DataFrame:
    """Standardised coefficients by magnitude, and how many are zero."""
    _, w, _ = _coefficients(spark, d)
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("weight")), "feature"))  # a row for each feature of the model
    return w.withColumn("place", place).crossJoin(w.agg(F.sum((F.col("weight") == 0).cast("int")).alias("zeros")))


@query("collinear_coefficients", digits=4)
def collinear_coefficients(spark, d) -> DataFrame:
    """Pairs of correlated features with their coefficients, and whether these pull in opposite directions."""
    train, w, _ = _coefficients(spark, d)
    pairs = screening.correlations(train, NUMBERS)
    own = lambda c: w.select(F.col("feature").alias(c), F.col("weight").alias(f"weight_{c}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").withColumn("opposite", F.col("weight_a") * F.col("weight_b") < 0)


@query("explanation_agreement", digits=4)
def explanation_agreement(spark, d) -> DataFrame:
    """Contributions of a linear model against a local linear surrogate, at the highest- and the lowest-scored positive."""
    train, w, weights = _coefficients(spark, d)
    score = reduce(lambda a, b: a + b, (F.lit(b) * F.col(c) for b, c in zip(weights[:-1], NUMBERS, strict=True)), F.lit(weights[-1]))
    predict = lambda t: t.withColumn("s", 1 / (1 + F.exp(-score)))
    positive = predict(train.where("y = 1")).withColumn("id", F.col("c_custkey").cast("long"))
    ends = positive.agg(F.min(F.struct(-F.col("s"), "id", *NUMBERS)).alias("a"), F.min(F.struct("s", "id", *NUMBERS)).alias("b"))
    cells = F.array(*(F.struct(F.col(f"{e}.id").alias("id"), *(F.col(f"{e}.{c}").alias(c) for c in NUMBERS)) for e in "ab"))
    cases = materialize(ends.select(F.explode(F.array_distinct(cells)).alias("c")).select("c.*"), "cases")  # one case if all scores are equal
    local = modelling.local_surrogate(cases, dict.fromkeys(NUMBERS, (0.0, 1.0)), predict, draws=2000)
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), (F.lit(b) * F.col(c)).alias("effect")) for b, c in zip(weights[:-1], NUMBERS, strict=True)))  # columns have mean 0
    long = cases.select("id", F.explode(parts).alias("c")).select("id", "c.*")
    return modelling.agreement(long, local, 2)


@query("block_independence", digits=4)
def block_independence(spark, d) -> DataFrame:
    """Independence of neighbouring order prices in blocks of 500: each block's value after Holm's adjustment, and all combined by Fisher."""
    found = materialize(modelling.block_independence(table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("x")), 500), "blocks")
    holm = inference.adjust_p(found.select(F.col("block").alias("name"), "p")).select(F.col("name").alias("block"), "holm")
    return found.join(holm, "block", "left").crossJoin(inference.combined_p(found).select("fisher", "fisher_p", "holm_least"))  # one row


@query("stationary_interval")
def stationary_interval(spark, d) -> DataFrame:
    """Interval of the mean loss difference of two models over 100 block means."""
    e = P.errors(spark, d).select("row", (F.col("e1") * F.col("e1") - F.col("e2") * F.col("e2")).alias("x"))
    return spark.createDataFrame([resampling.stationary_interval(resampling.block_series(e, ["x"], 100)[:, 0])], "mean double, low double, high double, length double")


@query("model_artifact")
def model_artifact(spark, d) -> DataFrame:
    """A fitted pipeline saved and loaded again: rows whose score differs."""
    from pyspark.ml import PipelineModel

    train, test = _prepared(spark, d)
    model = learners.learner("logistic_l2", NUMBERS, "y", regParam=0.01).fit(train)
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    a, b = (learners.scores(m, test).select("c_custkey", F.col("s").alias(n)) for m, n in ((model, "s"), (PipelineModel.load(path), "again")))
    return a.join(b, "c_custkey").agg(F.count("*").alias("n"), F.sum((F.col("s") != F.col("again")).cast("int")).alias("different"))
