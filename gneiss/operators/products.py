"""Sums of products of many columns: matrices instead of one aggregate for each pair.

Tasks sum whole matrices over their batches and give them row by row, so a
matrix meets itself in as many groups as it has rows. The plan has one size
whatever the number of columns; only the finished matrices, bounded by the
columns, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns at most: a matrix of them has 128 MB.
MAX_COLUMNS = 4_000


def matrix_sums(df: DataFrame, columns: Sequence[str], terms: Callable[[np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over batches of rows of the matrices of ``terms`` (of a batch's values, NaN: missing); empty for an empty table."""
    if len(columns) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
            for name, m in terms(x).items():
                sums[name] = sums[name] + m if name in sums else m
        for name, m in sums.items():
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(m), pa.string()), pa.array(np.arange(len(m)), pa.int32()), rows], ["name", "i", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head = None, None
        for batch in batches:
            cells = batch.column("cells").flatten().to_numpy().reshape(len(batch), -1).sum(0) if len(batch) else None
            if cells is not None:
                out, head = cells if out is None else out + cells, batch.slice(0, 1)
        if head is not None:
            yield pa.RecordBatch.from_arrays([head.column("name"), head.column("i"), pa.array([out], pa.list_(pa.float64()))], ["name", "i", "cells"])

    rows = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    made = rows.mapInArrow(partial, "name string, i int, cells array<double>").groupBy("name", "i").applyInArrow(total, "name string, i int, cells array<double>")
    found: dict[str, dict[int, list[float]]] = {}
    for r in made.collect():  # the rows of a few matrices
        found.setdefault(r.name, {})[r.i] = r.cells
    return {name: np.array([own[i] for i in range(len(own))]) for name, own in found.items()}


def correlations(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str, float | None, int]]:
    """Pearson correlation and rows of every pair of columns over rows where both are known; none for a column without spread there."""
    columns = list(columns)
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns))).first()
    shift = np.array([m if m is not None else 0.0 for m in means])

    def terms(x: np.ndarray) -> dict[str, np.ndarray]:
        known = ~np.isnan(x)
        x, m = np.where(known, x - shift, 0.0), known.astype(float)
        return {"n": m.T @ m, "x": x.T @ m, "xx": (x * x).T @ m, "xy": x.T @ x}

    s = matrix_sums(df, columns, terms)
    if not s:
        return [(a, b, None, 0) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    n = np.maximum(s["n"], 1)
    var = s["xx"] - s["x"] * s["x"] / n
    # what rounding leaves of a constant
    flat = (var <= 1e-12 * s["xx"]) | (var / n <= (1e-12 * np.abs(shift))[:, None] ** 2) | (s["n"] < 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.clip((s["xy"] - s["x"] * s["x"].T / n) / np.sqrt(var * var.T), -1, 1)
    none = flat | flat.T
    return [(a, b, None if none[i, j] else float(r[i, j]), int(s["n"][i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
