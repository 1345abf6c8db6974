"""Grid searches and tests of residuals, with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import columns as C
from gneiss.operators import grid, order, residuals, splits
from gneiss.plans import frames as P
from gneiss.plans.resumable import _LINES, CATEGORICAL, NUMERIC, _customers, _fitted

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Penalties and their strengths.
GRID = [("l2", c) for c in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)] + [("l1", c) for c in (0.01, 0.1, 1.0)]


def query(name: str, sql: str | None = None, plain: str = "", doubles: str = "", digits: int = 6):
    def keep(f):
        QUERIES[name] = lambda spark, d: C.tidy(f(spark, d), digits)
        if sql:
            ORACLES[name] = P.tidy_sql(sql, plain, doubles, digits)
        return f

    return keep


def _folds(spark, d) -> DataFrame:
    dev = _customers(spark, d).where("u < 0.8")
    return dev.join(splits.stratified(dev.select("c_custkey", "target"), "c_custkey", "target", {"all": 1.0}).select("c_custkey", "fold"), "c_custkey")


@query("grid_search")
def grid_search(spark, d) -> DataFrame:
    """Nine penalties of a logistic regression over five folds, each with its own fitted transformer."""
    return grid.grid_search(grid.fold_features(_folds(spark, d), "target", NUMERIC, CATEGORICAL), GRID)


def _tested(spark, d) -> DataFrame:
    # order and line number repeat
    return order.positions(_fitted(spark, d).where("part = 'test'"), *map(F.col, ("l_orderkey", "l_linenumber", "y", "fitted")), name="row")


@query("residual_bundle")
def residual_bundle(spark, d) -> DataFrame:
    """Every test of the residuals on test rows of a line through log prices."""
    return residuals.residual_bundle(_tested(spark, d))


def _chi2_sql(x: str, freedom: int) -> str:
    """Upper tail for an even number of degrees of freedom."""
    terms = " + ".join(f"pow(({x}) / 2, {i}) / {math.factorial(i)}.0" for i in range(freedom // 2))
    return f"exp(-({x}) / 2) * ({terms})"


_LAGS = range(1, 21)
_Q = {m: f"n * (n + 2) * ({' + '.join(f'pow(g{k} / g0, 2) / (n - {k})' for k in range(1, m + 1))})" for m in (10, 20)}


@query(
    "residual_tests",
    f"""with {_LINES}, e as (select row_number() over (order by l_orderkey, l_linenumber, y, fitted) as row, y - fitted as e, fitted as f from fitted where part = 'test'),
        c as (select row, e - (select avg(e) from e) as x from e), l as (select x, {', '.join(f'lag(x, {k}) over (order by row) as x{k}' for k in _LAGS)} from c),
        g as (select count(*) as n, sum(x * x) as g0, {', '.join(f'sum(x * x{k}) as g{k}' for k in _LAGS)}, avg(x * x) as m2, avg(pow(x, 3)) as m3, avg(pow(x, 4)) as m4 from l),
        v as (select e * e as y, f - (select avg(f) from e) as a, pow(f - (select avg(f) from e), 2) as b from e), t as (select var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as by_, var_pop(y) as yy from v),
        s as (select n, n * ((ay * ay * bb - 2 * ay * by_ * ab + by_ * by_ * aa) / (aa * bb - ab * ab)) / yy as white, {_Q[10]} as q_10, {_Q[20]} as q_20, m3 / pow(m2, 1.5) as skew, m4 / (m2 * m2) - 3 as kurtosis,
              n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) as jarque_bera from g, t)
        select *, exp(-white / 2) as p_white, {_chi2_sql('q_10', 10)} as p_10, {_chi2_sql('q_20', 20)} as p_20, exp(-jarque_bera / 2) as p_jarque_bera from s""",
    "n",
    "white, p_white, q_10, p_10, q_20, p_20, skew, kurtosis, jarque_bera, p_jarque_bera",
)
def residual_tests(spark, d) -> DataFrame:
    """The same tests but that of blocks."""
    return residuals.residual_bundle(_tested(spark, d), block=None)
