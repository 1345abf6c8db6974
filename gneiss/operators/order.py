"""Positions, running sums and lags over one long order, without a single task.

Rows are dealt by range of the order and the dealt table is written, so every
part keeps its rows; sums of whole parts (one row a part and group) give each
part its start, and windows run inside parts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.sources.storage import materialize

#: Rows of a block that lags look back in; a lag must be shorter.
BLOCK = 100_000


def running(df: DataFrame, order: Sequence[Column], values: dict[str, Column], by: Sequence[str] = (), how: str = "sum") -> DataFrame:
    """``df`` with running sums (or "max", "min") of ``values`` (the row included) in an order, within groups ``by``.

    Ties in the order are summed in any sequence, so make it a key where that
    matters. Groups must not be null. An empty table stays empty.
    """
    by, total = list(by), {"sum": F.sum, "max": F.max, "min": F.min}[how]
    join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}[how]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    valued = df.withColumns({f"__{name}": value for name, value in values.items()})
    dealt = materialize(valued.repartitionByRange(n, *map(F.col, by), *order).withColumn("__part", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(*by, "__part").agg(*(total(f"__{name}").alias(f"__sum_{name}") for name in values))
    # a row for each part of each group
    before = Window.partitionBy(*by, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "__part", *(total(f"__sum_{name}").over(before).alias(f"__start_{name}") for name in values))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(starts, [*by, "__part"]).withColumns({name: join(total(f"__{name}").over(inside), F.col(f"__start_{name}")) for name in values})
    return rows.drop("__part", *(f"__{name}" for name in values), *(f"__start_{name}" for name in values))


def positions(df: DataFrame, *order: Column, by: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """``df`` with the position (from 0) of each row in an order."""
    return running(df, order, {name: F.lit(1).cast("long")}, by).withColumn(name, F.col(name) - 1)


def equal_count_bin(pos: Column, n: Column, bins: int) -> Column:
    """Bin (from 1) of a position when ``n`` rows are cut into bins of equally many, the first ones one larger."""
    small, larger = F.floor(n / bins), n % bins
    edge = larger * (small + 1)
    return F.when(pos < edge, F.floor(pos / (small + 1))).otherwise(larger + F.floor((pos - edge) / F.greatest(small, F.lit(1)))).cast("long") + 1


def equal_count_bins(df: DataFrame, bins: int, *order: Column, name: str = "bin") -> DataFrame:
    placed = positions(df, *order, name="__pos")
    return placed.crossJoin(df.agg(F.count("*").alias("__n"))).withColumn(name, equal_count_bin(F.col("__pos"), F.col("__n"), bins)).drop("__pos", "__n")


def lagged(df: DataFrame, row: str, value: str, lags: Sequence[int]) -> DataFrame:
    """``df`` with ``lag_k`` of a column for each k, in order of ``row``.

    Rows are cut into blocks of positions; the last ones of a block go to the
    next block too, so no window is longer than a block.
    """
    most = max(lags)
    if most >= BLOCK:
        raise ValueError(f"lags must be under {BLOCK}")
    placed = positions(df, F.col(row), name="__pos").withColumn("__block", F.floor(F.col("__pos") / BLOCK))
    spread = F.when(F.col("__pos") % BLOCK >= BLOCK - most, F.array("__block", F.col("__block") + 1)).otherwise(F.array("__block"))
    both = placed.withColumn("__at", F.explode(spread))
    w = Window.partitionBy("__at").orderBy("__pos")
    out = both.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})
    return out.where("__at = __block").drop("__pos", "__block", "__at")


def _inside(lags: int) -> Callable:
    """Products of a sorted part, with the values at both its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, head, tail, n = np.zeros(lags + 1), np.zeros(0), np.zeros(0), 0
        for batch in batches:
            own = batch.column("x").to_numpy(zero_copy_only=False)
            x, n = np.concatenate([tail, own]), n + len(own)
            for k in range(lags + 1):
                at = max(len(tail), k)
                if at < len(x):
                    sums[k] += x[at:] @ x[at - k : len(x) - k]
            if len(head) < lags:
                head = np.concatenate([head, own])[:lags]
            tail = x[max(len(x) - lags, 0) :]
        if n:
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), *(pa.array([v], pa.list_(pa.float64())) for v in (sums, head, tail))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "n", "sums", "head", "tail"])

    return run


def _across(lags: int) -> Callable:
    """Products of all parts: those inside, and those of a part's first values with the last ones before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, carried, n = np.zeros(lags + 1), np.zeros(0), 0
        for batch in batches:
            for part in batch.to_pylist():
                head, tail = np.array(part["head"]), np.array(part["tail"])
                x = np.concatenate([carried, head])
                for k in range(1, lags + 1):
                    # positions in the head whose partner lies before the part
                    low, high = max(len(carried), k), min(len(carried) + k, len(x))
                    if low < high:
                        total[k] += x[low:high] @ x[low - k : high - k]
                total, n = total + np.array(part["sums"]), n + part["n"]
                both = np.concatenate([carried, tail])
                carried = both[max(len(both) - lags, 0) :]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["n", "sums"])

    return run


def lag_products(df: DataFrame, row: str, value: str, lags: int) -> DataFrame:
    """``n`` and ``sums``: for k from 0 to ``lags`` the sum of products of a column (without nulls) and its value k rows before, in order of ``row``.

    Rows are dealt by range once and summed as they stream by. What meets
    beyond a part's ends is in the first and last values of the parts, of
    which one task reads a row for each part. An empty table gives no row.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.select(row, F.col(value).cast("double").alias("x")).repartitionByRange(n, F.col(row)).sortWithinPartitions(row).select("x")
    parts = dealt.mapInArrow(_inside(lags), "part int, n long, sums array<double>, head array<double>, tail array<double>")
    return parts.repartition(1).sortWithinPartitions("part").mapInArrow(_across(lags), "n long, sums array<double>")


def rolling(df: DataFrame, order: Sequence[Column], values: dict[str, Column], window: int, least: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with means of ``values`` over a centred window of rows in an order, within groups ``by`` (not null).

    A window of w rows has w // 2 of them before the row. A mean of fewer than
    ``least`` values (all of the window, if not given) is null, as at both
    ends; means are doubles. Rows are cut into blocks of positions; those
    within reach of a neighbouring block go there too, so no window is longer
    than a block. Inside a block the order is cut into runs of as many rows as
    the window, which so is the end of a run and the start of the next: each
    row is summed twice whatever the width, and nothing is subtracted.
    """
    before, after, least = window // 2, window - window // 2 - 1, window if least is None else least
    if before >= BLOCK:
        raise ValueError(f"windows must be under {2 * BLOCK} rows")
    placed = positions(df.withColumns({f"__of_{name}": value.cast("double") for name, value in values.items()}), *order, by=by, name="__pos").withColumn("__block", F.floor(F.col("__pos") / BLOCK))
    inside = F.col("__pos") % BLOCK
    reached = F.filter(F.array("__block", F.when(inside >= BLOCK - before, F.col("__block") + 1), F.when(inside < after, F.col("__block") - 1)), lambda b: b.isNotNull() & (b >= 0))
    spread = placed.withColumn("__at", F.explode(reached)).withColumn("__run", F.floor(F.col("__pos") / window)).repartition(*map(F.col, by), "__at")
    run, whole = Window.partitionBy(*by, "__at", "__run"), Window.partitionBy(*by, "__at").orderBy("__pos")
    sums = lambda w: F.struct("__run", *(f(f"__of_{name}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{kind}_{name}") for name in values for kind, f in (("sum", F.sum), ("n", F.count))))
    spread = spread.withColumn("__upto", sums(run.orderBy("__pos"))).withColumn("__from", sums(run.orderBy(F.desc("__pos"))))
    end = F.last("__upto").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    spread = spread.withColumn("__first", F.lag("__from", before).over(whole)).withColumn("__last", F.coalesce(F.lead("__upto", after).over(whole), end))
    # one run holds a window that starts a run or is cut off by an end of the table
    one = F.col("__first.__run") == F.col("__last.__run")

    def total(field: str) -> Column:
        first, last = (F.coalesce(F.col(f"{side}.{field}"), F.lit(0)) for side in ("__first", "__last"))
        return F.when(one, first).otherwise(first + last)

    means = {name: F.when(total(f"n_{name}") >= max(least, 1), total(f"sum_{name}") / total(f"n_{name}")) for name in values}
    return spread.where("__at = __block").withColumns(means).drop("__pos", "__block", "__at", "__run", "__upto", "__from", "__first", "__last", *(f"__of_{name}" for name in values))


def tie_ranks(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False, name: str = "rank_avg") -> DataFrame:
    """``df`` with ranks (ties averaged) within groups, from one row for each distinct value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    upto = running(counts, [F.desc(value) if descending else F.asc(value)], {"__upto": F.col("__n")}, by)
    ranks = upto.select(*by, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(ranks, [*by, value])
