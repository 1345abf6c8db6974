"""Cross-validated grids of penalised logistic regressions, all fits at once.

The fits of a grid differ in their fold and their penalty. Each round of
Newton's method is one pass over the rows for all of them: tasks sum gradients
and curvatures, give them row by row, and one group a fit solves its small
system. Only weights reach the driver. A grid of m candidates and k folds
reads its rows as often as its slowest fit has rounds, not m * k times that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import metrics, transformer
from gneiss.sources.storage import materialize

#: Cells of all curvature matrices of one task at most (8 bytes each).
MAX_CELLS = 32_000_000
Candidate = tuple[str, float]


def fold_features(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (), fold: str = "fold", folds: int = 5) -> DataFrame:
    """Rows of every fold's fit: ``fold``, ``held`` (not among its fitting rows), ``y``, ``features``.

    A fold's transformer is fitted on its fitting rows alone; all folds are
    one pass. Rows without a class or a fold are left out.
    """
    known = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull())
    spread = known.withColumn("__fit", F.explode(F.array(*map(F.lit, range(folds))))).where(F.col(fold) != F.col("__fit"))
    states = materialize(transformer.fit(spread, numeric, categorical, ["__fit"]), "fold_states")
    own = {k: transformer.rows_of(states.where(F.col("__fit") == k).drop("__fit")) for k in range(folds)}
    fits = [F.struct(F.lit(k).alias("fold"), (F.col(fold) == k).alias("held"), transformer.features(state).alias("features")) for k, state in own.items() if state]
    if not fits:
        return df.sparkSession.createDataFrame([], "fold int, held boolean, y double, features array<double>")
    return known.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*fits)).alias("f")).select("f.fold", "f.held", "y", "f.features")


def _matrix(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    x = batch.column("features").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
    return np.column_stack([x, np.ones(len(at))])


def _chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))


def _partial(weights: dict[int, dict[int, np.ndarray]], classes: dict[int, tuple[float, float]]) -> Callable:
    """Sums of a task: for each fit a row of its loss (i = -1) and of each weight's gradient and curvature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            folds, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
            for k, own in weights.items():
                at = np.flatnonzero(folds == k)
                if not len(at):
                    continue
                x, t = _matrix(batch, at), y[at]
                share = np.where(t == 1, classes[k][1], classes[k][0])
                for c, w in own.items():
                    p, z = _chance(x, w), x @ w
                    made = [share @ (np.logaddexp(0, z) - t * z), x.T @ (share * (p - t)), x.T @ (x * (share * p * (1 - p))[:, None])]
                    old = sums.get((k, c))
                    sums[k, c] = made if old is None else [a + b for a, b in zip(old, made, strict=True)]
        for (k, c), (loss, gradient, curvature) in sums.items():
            cells = [[float(loss)], *np.column_stack([gradient, curvature])]
            columns = [pa.array([k] * len(cells), pa.int32()), pa.array([c] * len(cells), pa.int32()), pa.array(range(-1, len(cells) - 1), pa.int32()), pa.array(cells, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["fold", "candidate", "i", "cells"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, head = None, None
    for batch in batches:
        if len(batch):
            cells = batch.column("cells").flatten().to_numpy().reshape(len(batch), -1).sum(0)
            out, head = cells if out is None else out + cells, batch.slice(0, 1)
    if head is not None:
        yield pa.RecordBatch.from_arrays([*(head.column(c) for c in ("fold", "candidate", "i")), pa.array([out], pa.list_(pa.float64()))], ["fold", "candidate", "i", "cells"])


def _step(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, penalty: str, c: float, sweeps: int = 500) -> np.ndarray:
    """Newton's step of the penalised loss; the last weight, the intercept, has no penalty."""
    d = len(w) - 1
    if penalty == "l2":
        ridge = np.diag([1 / c] * d + [0.0])
        return -np.linalg.lstsq(curvature + ridge, gradient + ridge @ w, rcond=None)[0]
    # l1: the parabola's minimum by coordinates
    step, slope = np.zeros(d + 1), gradient.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(d + 1):
            bend = curvature[j, j]
            if bend <= 1e-12:
                continue
            at = w[j] + step[j] - slope[j] / bend
            new = at if j == d else np.sign(at) * max(abs(at) - 1 / (c * bend), 0.0)
            move = new - w[j] - step[j]
            if move:
                step[j] += move
                slope += move * curvature[:, j]
                most = max(most, abs(move))
        if most < 1e-12:
            break
    return step


def _solve(candidates: Sequence[Candidate], weights: dict[int, dict[int, np.ndarray]]) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        k, c = rows[0]["fold"], rows[0]["candidate"]
        cells = np.array([r["cells"] for r in rows[1:]])
        step = _step(weights[k][c], cells[:, 0], cells[:, 1:], *candidates[c])
        return pa.table({"fold": pa.array([k], pa.int32()), "candidate": pa.array([c], pa.int32()), "loss": pa.array([rows[0]["cells"][0]]), "step": pa.array([step.tolist()], pa.list_(pa.float64()))})

    return run


def _penalty(w: np.ndarray, kind: str, c: float) -> float:
    return float(w[:-1] @ w[:-1] / 2 if kind == "l2" else np.abs(w[:-1]).sum()) / c


def fit_grid(rows: DataFrame, candidates: Sequence[Candidate], balanced: bool = True, rounds: int = 100, tolerance: float = 1e-8) -> dict[tuple[int, int], np.ndarray]:
    """Weights (and the intercept, last) of each fold and candidate, fitted on the rows that the fold doesn't hold.

    A candidate (kind, c) minimises c times the logistic loss plus |w|^2 / 2
    ("l2") or |w| ("l1"). With ``balanced``, rows weigh n / (2 * n of their
    class). A step that makes the loss larger is halved. Folds whose fitting
    rows lack a class have no fits.
    """
    for kind, c in candidates:
        if kind not in ("l1", "l2") or not c > 0:
            raise ValueError((kind, c))
    seen = rows.where("not held").groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.max(F.size("features")).alias("d")).collect()  # a row for each fold
    sizes = {r.fold: r for r in seen if 0 < r.p < r.n}
    if sum((r.d + 1) ** 2 for r in sizes.values()) * len(candidates) > MAX_CELLS:
        raise ValueError(f"curvatures of more than {MAX_CELLS} cells: take fewer candidates or folds at once")
    classes = {k: (r.n / (2 * (r.n - r.p)), r.n / (2 * r.p)) if balanced else (1.0, 1.0) for k, r in sizes.items()}
    now = {(k, c): np.zeros(r.d + 1) for k, r in sizes.items() for c in range(len(candidates))}
    before: dict[tuple[int, int], tuple[np.ndarray, float]] = {}
    open_fits = set(now)
    for _ in range(rounds):
        if not open_fits:
            break
        weights: dict[int, dict[int, np.ndarray]] = {}
        for k, c in sorted(open_fits):
            weights.setdefault(k, {})[c] = now[k, c]
        fitting = rows.where(~F.col("held") & F.col("fold").isin(list(weights)))
        schema = "fold int, candidate int, i int, cells array<double>"
        sums = fitting.mapInArrow(_partial(weights, classes), schema).groupBy("fold", "candidate", "i").applyInArrow(_total, schema)
        for r in sums.groupBy("fold", "candidate").applyInArrow(_solve(candidates, weights), "fold int, candidate int, loss double, step array<double>").collect():  # a row for each fit
            at, step = (r.fold, r.candidate), np.array(r.step)
            w, value = now[at], r.loss + _penalty(now[at], *candidates[r.candidate])
            if at in before and value > before[at][1] + 1e-10 * abs(before[at][1]):
                now[at] = (before[at][0] + w) / 2
                continue
            before[at], now[at] = (w, value), w + step
            if np.abs(step).max() <= tolerance * max(1.0, np.abs(w).max()):
                open_fits.discard(at)
    return now


def grid_scores(rows: DataFrame, weights: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """``fold``, ``candidate``, ``held``, ``y``, ``s`` of every row under every candidate of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            for k in np.unique(folds):
                at = np.flatnonzero(folds == k)
                x, own = _matrix(batch, at), batch.take(pa.array(at))
                for (j, c), w in weights.items():
                    if j == k:
                        columns = [own.column("fold"), pa.array([c] * len(at), pa.int32()), own.column("held"), own.column("y"), pa.array(_chance(x, w))]
                        yield pa.RecordBatch.from_arrays(columns, ["fold", "candidate", "held", "y", "s"])

    return rows.mapInArrow(run, "fold int, candidate int, held boolean, y double, s double")


def grid_search(rows: DataFrame, candidates: Sequence[Candidate], **fit) -> DataFrame:
    """Each candidate's mean AUC on fitting and held rows over the folds of :func:`fold_features`.

    Returns ``kind``, ``c``, ``folds`` (with an AUC), ``mean_train``,
    ``mean_test``, ``sd_test`` (of the population), ``place`` (1: best, ties
    share one; null without an AUC), ``chosen`` (the first of the best in the
    given order) and ``at_edge`` (it is the chosen one and its c the least or
    largest of its kind: widen the range).
    """
    kept = materialize(rows, "grid_rows")
    weights = fit_grid(kept, candidates, **fit)
    auc = metrics.ranking(grid_scores(kept, weights), ["fold", "candidate", "held"])
    means = auc.groupBy("candidate").agg(
        F.avg(F.when(~F.col("held"), F.col("auc"))).alias("mean_train"), F.avg(F.when(F.col("held"), F.col("auc"))).alias("mean_test"), F.stddev_pop(F.when(F.col("held"), F.col("auc"))).alias("sd_test"),
        F.count(F.when(F.col("held"), F.col("auc"))).alias("folds"),
    )
    found = {r.candidate: r for r in means.collect()}  # a row for each candidate
    tests = {i: r.mean_test for i, r in found.items() if r.mean_test is not None}
    best = min((i for i in tests if tests[i] == max(tests.values())), default=None)
    out = []
    for i, (kind, c) in enumerate(candidates):
        r, place = found.get(i), 1 + sum(v > tests[i] for v in tests.values()) if i in tests else None
        span = [v for other, v in candidates if other == kind]
        out.append((kind, float(c), r.folds if r else 0, r.mean_train if r else None, r.mean_test if r else None, r.sd_test if r else None, place, i == best, i == best and c in (min(span), max(span))))
    return rows.sparkSession.createDataFrame(out, "kind string, c double, folds long, mean_train double, mean_test double, sd_test double, place int, chosen boolean, at_edge boolean")
