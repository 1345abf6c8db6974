"""All tests of a fit's residuals as one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.distributions import chi2_upper
from gneiss.operators import inference, modelling
from gneiss.operators.resampling import white_test
from gneiss.sources.storage import materialize


def residual_bundle(df: DataFrame, lags: Sequence[int] = (10, 20), block: int | None = 5000) -> DataFrame:
    """Tests of ``y`` - ``fitted`` in the order of ``row``: constant variance, autocorrelation, normality, and independence of blocks.

    One row: ``n``, ``white`` and ``p_white`` (regression of squares on the
    fit and its square), ``q_<lag>`` and ``p_<lag>`` (Ljung-Box), ``skew``,
    ``kurtosis``, ``jarque_bera`` and ``p_jarque_bera``; with ``block``,
    ``p_blocks_fisher`` and ``p_blocks_holm`` of the test of every block.
    Rows with a missing value are left out; what can't be computed (no rows,
    no spread) is null. All autocorrelations are one pass.
    """
    known = df.where("row is not null and y is not null and fitted is not null")
    e = materialize(known.select("row", (F.col("y") - F.col("fitted")).cast("double").alias("x"), F.col("fitted").cast("double").alias("f")), "residuals")
    p = lambda statistic, freedom: None if statistic is None or statistic != statistic else chi2_upper(max(statistic, 0.0), freedom)
    moments = inference.jarque_bera(e).first()
    white = white_test(e.select(F.col("x").alias("e"), "f")).first().lm
    g = inference.autocovariances(e, max(lags)).first()
    out: dict[str, float | int | None] = {"n": moments.n, "white": white, "p_white": p(white, 2)}
    for most in lags:
        q = g.n * (g.n + 2) * sum((g[f"g{k}"] / g.g0) ** 2 / (g.n - k) for k in range(1, most + 1)) if g.g0 and g.n > most else None
        out |= {f"q_{most}": q, f"p_{most}": p(q, most)}
    finite = lambda v: None if v is None or v != v else v
    out |= {"skew": finite(moments.skew), "kurtosis": finite(moments.kurtosis), "jarque_bera": finite(moments.jb), "p_jarque_bera": p(moments.jb, 2)}
    if block:
        blocks = inference.combined_p(modelling.block_independence(e, block)).first()
        out |= {"p_blocks_fisher": blocks.fisher_p, "p_blocks_holm": blocks.holm_least}
    return df.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"{name} {'long' if name == 'n' else 'double'}" for name in out))
