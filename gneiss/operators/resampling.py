"""Bootstrap intervals and tests whose input is a short series of blocks.

Long tables are first collapsed by Spark to block means (``block_series``), a
bounded matrix of at most MAX_BLOCKS rows; only that reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 5_000


def block_series(df: DataFrame, columns: Sequence[str], blocks: int) -> np.ndarray:
    """Means of equal runs of rows in the order of ``row``; at most MAX_BLOCKS of them."""
    if blocks > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks")
    cut = df.agg(F.percentile_approx("row", F.array(*(F.lit(i / blocks) for i in range(1, blocks))), 10 * blocks)).first()[0] or []
    at = F.size(F.filter(F.array(*(F.lit(c) for c in cut)), lambda e: e < F.col("row"))) if cut else F.lit(0)
    rows = df.groupBy(at.alias("block")).agg(*(F.avg(c).alias(c) for c in columns)).orderBy("block").collect()
    return np.array([[r[c] for c in columns] for r in rows], float)


def bootstrap_bca(statistic: Callable[..., float], *arrays: np.ndarray, groups: np.ndarray | None = None, n: int = 2000, level: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """Statistic with its bias-corrected accelerated interval; resampling keeps group sizes."""
    rng, normal = np.random.default_rng(seed), NormalDist()
    size = len(arrays[0])
    groups = np.zeros(size, int) if groups is None else groups
    members = [np.flatnonzero(groups == g) for g in np.unique(groups)]
    point = statistic(*arrays)
    draws = np.array([statistic(*(a[i] for a in arrays)) for i in (np.concatenate([rng.choice(m, len(m)) for m in members]) for _ in range(n))])
    z0 = normal.inv_cdf(min(max(float(np.mean(draws < point) + np.mean(draws == point) / 2), 1 / (2 * n)), 1 - 1 / (2 * n)))
    leave = np.array([statistic(*(np.delete(a, part) for a in arrays)) for part in np.array_split(np.arange(size), min(size, 200))])
    gap = leave.mean() - leave
    accel = float((gap**3).sum() / (6 * ((gap**2).sum() ** 1.5 or 1.0)))
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(float(np.quantile(draws, normal.cdf(z0 + z / (1 - accel * z)))))
    return point, ends[0], ends[1]


def stationary_indices(n: int, length: float, rng: np.random.Generator) -> np.ndarray:
    """One stationary-bootstrap sample of 0..n-1: blocks of geometric length, wrapping around."""
    start = rng.random(n) < 1 / length
    start[0] = True
    jump = rng.integers(0, n, n)
    at = np.flatnonzero(start)[np.cumsum(start) - 1]
    return (jump[at] + np.arange(n) - at) % n


def block_length(x: np.ndarray) -> float:
    """Mean block length of the stationary bootstrap by the automatic rule of Politis and White (flat-top window, 2009 correction)."""
    n, d = len(x), x - x.mean()
    run, most = max(5, math.ceil(math.sqrt(math.log10(n)))), math.ceil(math.sqrt(n))
    most = min(most + run, n - 1)
    g = np.array([d[k:] @ d[: n - k] / n for k in range(most + 1)])
    if g[0] <= 0:
        return 1.0
    small = np.abs(g[1:] / g[0]) < 2 * math.sqrt(math.log10(n) / n)
    quiet = [m for m in range(len(small) - run + 1) if small[m : m + run].all()]
    large = np.flatnonzero(~small)
    m = quiet[0] if quiet else int(large[-1]) + 1 if len(large) else 1
    reach = min(2 * max(m, 1), most)
    k = np.arange(1, reach + 1)
    window = np.where(k / reach <= 0.5, 1.0, 2 * (1 - k / reach))
    slope, spectrum = 2 * (window * k * g[k]).sum(), g[0] + 2 * (window * g[k]).sum()
    best = (slope * slope / (spectrum * spectrum) * n) ** (1 / 3) if spectrum else 1.0
    return float(min(max(best, 1.0), math.ceil(min(3 * math.sqrt(n), n / 3))))


def stationary_interval(x: np.ndarray, n: int = 1000, level: float = 0.95, seed: int = 42) -> tuple[float, float, float, float]:
    """Mean of a series, its percentile interval under the stationary bootstrap, and the block length."""
    rng, length = np.random.default_rng(seed), block_length(x)
    means = np.array([x[stationary_indices(len(x), length, rng)].mean() for _ in range(n)])
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(x.mean()), float(low), float(high), length


def confidence_set(losses: np.ndarray, names: Sequence[str], alpha: float = 0.1, length: float = 5.0, n: int = 1000, seed: int = 42) -> dict[str, tuple[float, bool]]:
    """Model confidence set (range statistic): each model's p-value, and whether it is in the set (p over alpha).

    Models of equal losses are one model and share its p-value.
    """
    distinct, group = np.unique(losses, axis=1, return_inverse=True)
    first = [int(np.flatnonzero(group == g)[0]) for g in range(distinct.shape[1])]
    rng, alive, out, running = np.random.default_rng(seed), sorted(first), {}, 0.0
    means = np.array([losses[stationary_indices(len(losses), length, rng)].mean(0) for _ in range(n)])
    while len(alive) > 1:
        m, boot = losses[:, alive].mean(0), means[:, alive]
        d, centred = m[:, None] - m[None], (boot - m)[:, :, None] - (boot - m)[:, None, :]
        sd = np.sqrt((centred**2).mean(0)) + np.eye(len(alive)) + 1e-300
        t = np.abs(d) / sd
        p = float((np.abs(centred / sd).max((1, 2)) >= t.max()).mean())
        running = max(running, p)
        worst = int((d / sd).max(1).argmax())
        out[group[alive.pop(worst)]] = running
    out[group[alive[0]]] = 1.0
    return {name: (out[g], out[g] > alpha) for name, g in zip(names, group, strict=True)}


def reality_check(benchmark: np.ndarray, losses: np.ndarray, length: float = 5.0, n: int = 1000, seed: int = 42, alpha: float = 0.05, names: Sequence[str] | None = None) -> dict:
    """p-values of "no model beats the benchmark", and which models a stepwise test at ``alpha`` finds better.

    ``reality_check`` isn't studentised; ``spa_lower``, ``spa`` and
    ``spa_upper`` are, with models that do badly recentred fully, beyond a
    limit, or not at all. The stepwise test is studentised: models whose gain
    exceeds the critical value leave, and it is drawn anew for the rest.
    ``better`` counts the models in ``names`` (by number, if not named). Models
    of the benchmark's own losses are left out.
    """
    rng, gain = np.random.default_rng(seed), benchmark[:, None] - losses
    names = [str(i) for i in range(gain.shape[1])] if names is None else list(names)
    size, mean, root = len(gain), gain.mean(0), np.sqrt(len(gain))
    boot = np.array([gain[stationary_indices(size, length, rng)].mean(0) for _ in range(n)])
    own = np.flatnonzero((gain != 0).any(0))
    if not len(own):
        return {"better": 0.0, "reality_check": 1.0, "spa_lower": 1.0, "spa": 1.0, "spa_upper": 1.0, "names": []}
    mean, boot = mean[own], boot[:, own]
    sd = boot.std(0) * root + 1e-300
    t = root * mean / sd
    limit = -np.sqrt(2 * np.log(np.log(max(size, 16))))
    centres = {"spa_lower": np.maximum(mean, 0), "spa": np.where(t >= limit, mean, 0.0), "spa_upper": mean}
    out: dict = {k: float((np.maximum((root * (boot - c) / sd).max(1), 0) >= max(t.max(), 0)).mean()) for k, c in centres.items()}
    out["reality_check"] = float((root * (boot - mean).max(1) >= root * mean.max()).mean())
    better, left, drawn = [], np.arange(len(own)), root * (boot - mean) / sd
    while len(left):  # the critical value falls as models that are better leave
        found = t[left] > np.quantile(drawn[:, left].max(1), 1 - alpha)
        if not found.any():
            break
        better += left[found].tolist()
        left = left[~found]
    return out | {"better": float(len(better)), "names": [names[own[i]] for i in sorted(better)]}


def white_test(df: DataFrame) -> DataFrame:
    """White's statistic n * R2 of squared errors ``e`` on (1, f, f^2), from moments; null without spread.

    ``f`` is centred first, which changes nothing but the rounding: far from
    zero a small spread and its squares are nearly in line.
    """
    f, y = F.col("f") - F.col("__mean"), F.col("e") * F.col("e")
    a, b = f, f * f
    t = df.crossJoin(df.agg(F.avg("f").alias("__mean"))).agg(F.count("*").alias("n"), F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.covar_pop(a, b).alias("ab"), F.covar_pop(a, y).alias("ay"), F.covar_pop(b, y).alias("by"), F.var_pop(y).alias("yy"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    fit = F.try_divide(F.col("ay") * F.col("ay") * F.col("bb") - 2 * F.col("ay") * F.col("by") * F.col("ab") + F.col("by") * F.col("by") * F.col("aa"), det)
    return t.select("n", F.try_divide(F.col("n") * fit, F.col("yy")).alias("lm"))


def nemenyi_p(df: DataFrame) -> list[tuple[str, str, float]]:
    """Pairwise p-values of mean ranks of ``block``, ``model``, ``score`` (a few models)."""
    from gneiss.functions.distributions import studentized_range_upper
    from gneiss.operators.inference import average_ranks

    r = average_ranks(df, ["block"], "score", True).groupBy("model").agg(F.avg("rank_avg").alias("r"), F.count("*").alias("n")).orderBy("model").collect()
    k = len(r)
    se = np.sqrt(k * (k + 1) / (6 * r[0].n)) if r else 1.0
    return [(a.model, b.model, studentized_range_upper(abs(a.r - b.r) / se * np.sqrt(2), k)) for i, a in enumerate(r) for b in r[i + 1 :]]
