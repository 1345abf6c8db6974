"""A bit sieve of fixed size: cuts rows before a shuffle, never decides.

The sieve of a key column is a bit array whose size is a parameter, whatever
the number of keys, so broadcasting it is bounded. A key that is in the column
always passes; others pass by chance, and an exact join follows. As keys
outgrow the bits, more rows pass: results stay whole, only the saving shrinks.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 23


def sieve(keys: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """Broadcast of 2**bits bits, built by a grouped ``bit_or`` (at most 2**(bits-6) rows)."""
    words = (
        keys.where(F.col(column).isNotNull())
        .select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("slot"))
        .selectExpr("cast(shiftright(slot, 6) as int) as word", "shiftleft(1L, cast(slot & 63 as int)) as bit")
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64)
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the (64-bit) keys may be in the sieve's column."""
    slot = keys.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
