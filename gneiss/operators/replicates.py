"""Bootstrap replicates as an axis of every row.

A row's weight in a replicate is a Poisson count drawn from a hash of its key,
so a repeated task draws the same and SQL can draw it too. Rows carry all their
weights as one array; statistics of all replicates come from one pass. A
jackknife group is a replicate that leaves out the rows of one hash bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.columns import hash_order
from gneiss.sources.storage import materialize

#: Chance of at most 0, 1, 2, ... in a Poisson count of mean 1.
STEPS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)]).tolist()
#: Draws that share one digest, of 32 bits each.
SHARED = 4


def draws(key: str, number: int, seed: int = 42) -> Column:
    """Array of ``number`` Poisson weights of a row."""
    digests = F.transform(F.sequence(F.lit(0), F.lit(-(-number // SHARED) - 1)), lambda b: hash_order(key, b, seed=seed))
    parts = F.flatten(F.transform(digests, lambda h: F.array(*(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("double") / F.lit(2.0**32) for i in range(SHARED)))))
    steps = F.array(*map(F.lit, STEPS))
    return F.slice(F.transform(parts, lambda u: F.size(F.filter(steps, lambda x: x <= u))), 1, number)


def leave_outs(key: str, groups: int, seed: int = 43) -> Column:
    """Array of 0 and 1: the row without its jackknife group."""
    own = F.pmod(F.conv(F.substring(hash_order(key, seed=seed), 1, 8), 16, 10).cast("long"), F.lit(groups))
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: (g != own).cast("int"))


def weights_sql(key: str, replicate: str, seed: int = 42) -> str:
    """The weight of :func:`draws` in DuckDB SQL."""
    digest = f"md5(cast({key} as varchar) || '|' || cast({replicate} // {SHARED} as varchar) || '|{seed}')"
    u = f"(cast(cast('0x' || substr({digest}, cast(8 * ({replicate} % {SHARED}) + 1 as integer), 8) as ubigint) as double) / 4294967296.0)"
    return f"len(list_filter({STEPS}, lambda x: x <= {u}))"


def _part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of both classes and wins within a part whose rows are in order of the score."""
    below = open_pos = open_neg = wins = pos = neg = None
    last, part = None, None
    for batch in batches:
        if not len(batch):
            continue
        part = batch.column("part")[0].as_py()
        s, y = batch.column("s").to_numpy(), batch.column("y").to_numpy()
        w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1).astype(np.float64)
        if below is None:
            below, open_pos, open_neg, wins, pos, neg = (np.zeros(w.shape[1]) for _ in range(6))
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        p, n = (np.add.reduceat(w * (y == k)[:, None], starts, axis=0) for k in (1, 0))
        pos, neg = pos + p.sum(0), neg + n.sum(0)
        if s[0] == last:
            p[0], n[0] = p[0] + open_pos, n[0] + open_neg
        else:
            wins, below = wins + open_pos * (below + open_neg / 2), below + open_neg
        # all scores of the batch but the last are whole
        under = below + np.cumsum(n, axis=0) - n
        wins = wins + (p[:-1] * (under[:-1] + n[:-1] / 2)).sum(0)
        below, open_pos, open_neg, last = under[-1], p[-1], n[-1], s[-1]
    if below is not None:
        wins = wins + open_pos * (below + open_neg / 2)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), **{k: pa.array([v], pa.list_(pa.float64())) for k, v in (("pos", pos), ("neg", neg), ("wins", wins))}})


def replicate_auc(df: DataFrame, weights: Column) -> DataFrame:
    """``replicate`` (from 0) and ``auc`` of ``y``, ``s`` for each place of the array ``weights``.

    Rows are dealt by range of the score once; each part gives its classes'
    weights and the wins within it, and parts meet in a table of parts times
    replicates. Rows without y or s are left out; a replicate without a class
    has a null AUC.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.where(F.col("y").isNotNull() & F.col("s").isNotNull()).select(F.col("y").cast("int").alias("y"), F.col("s").cast("double").alias("s"), weights.alias("w"))
    dealt = rows.repartitionByRange(n, "s").sortWithinPartitions("s").withColumn("part", F.spark_partition_id())
    parts = materialize(dealt.mapInArrow(_part_sums, "part int, pos array<double>, neg array<double>, wins array<double>"), "replicate_parts")
    each = parts.select("part", F.posexplode(F.arrays_zip("pos", "neg", "wins")).alias("replicate", "x")).select("part", "replicate", "x.*")
    before = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    sums = each.groupBy("replicate").agg(F.sum(F.col("wins") + F.col("pos") * F.col("below")).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select("replicate", F.try_divide("u", F.col("p") * F.col("n")).alias("auc"))


def replicate_means(df: DataFrame, value: str, weights: Column, by: str) -> DataFrame:
    """Weighted mean of a column in each group (``by``) and replicate."""
    each = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("__v"), F.posexplode(weights).alias("replicate", "w"))
    return each.groupBy(by, "replicate").agg(F.try_divide(F.sum(F.col("w") * F.col("__v")), F.sum("w")).alias("mean"))


def bca(point: float, drawn: np.ndarray, left: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    """Ends of the bias-corrected accelerated interval from replicates and jackknife values."""
    normal, n = NormalDist(), len(drawn)
    share = float(np.mean(drawn < point) + np.mean(drawn == point) / 2)
    z0 = normal.inv_cdf(min(max(share, 1 / (2 * n)), 1 - 1 / (2 * n)))
    gap = left.mean() - left
    accel = float((gap**3).sum() / (6 * ((gap**2).sum() ** 1.5 or 1.0)))
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(float(np.quantile(drawn, normal.cdf(z0 + z / (1 - accel * z)))))
    return ends[0], ends[1]


def auc_interval(df: DataFrame, key: str, number: int = 1000, groups: int = 100, level: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """AUC of ``y``, ``s`` over all rows and its BCa interval.

    Counts are drawn for each row by itself; as the AUC depends on shares
    within classes alone, each class is a stratum. Replicates reach the driver,
    one number each.
    """
    weights = F.concat(F.array(F.lit(1)), draws(key, number, seed), leave_outs(key, groups, seed + 1))
    found = dict(replicate_auc(df, weights).collect())  # number + groups + 1 rows
    known = lambda a, b: np.array([found[i] for i in range(a, b) if found.get(i) is not None])
    if found.get(0) is None:
        return float("nan"), float("nan"), float("nan")
    return found[0], *bca(found[0], known(1, number + 1), known(number + 1, number + groups + 1), level)
