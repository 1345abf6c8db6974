"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a random product code: the vector space is cut into
three blocks with k random unit codewords each, and every triple of codewords
is a direction; each of several independent codes rotates the space first. A unit vector is list-decoded to all directions whose inner
product with it exceeds a threshold: branches are cut as soon as the best
codewords of the blocks left can't lift the sum over it. Vectors that share a
direction of some code are candidates. A sketch of a byte a coordinate drops
those that rounding can't lift to the least cosine; the cosine of the others is
computed in double precision.

The number of directions grows with the number of vectors and the threshold
with it, so a vector keeps about FILTERS directions and a direction few
vectors at every size; a vector over the threshold of fewer than LEAST
directions goes to its LEAST best ones. Codes are added until RECALL of random
pairs at the least cosine share a direction, so their number grows with the
vectors. Equal vectors are one class from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.graph import connected_components
from gneiss.sources.storage import materialize

MIN_COSINE = 0.9
#: Directions of a code a vector is decoded to: on average, and at least; directions there are for each vector.
FILTERS, LEAST, DIRECTIONS = 60, 8, 256
BLOCKS = 3
#: Share of the random pairs at MIN_COSINE, and how many, that must share a direction of some code.
RECALL, PAIRS = 0.99, 2000


def _codes(dim: int, k: int, number: int = 0) -> tuple[np.ndarray, list[tuple[slice, np.ndarray]]]:
    """Rotation of a code, and blocks of the coordinates with their codewords, the same on every machine."""
    rng = np.random.Generator(np.random.PCG64([64064, number]))
    cuts = [dim * b // BLOCKS for b in range(BLOCKS + 1)]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        words = rng.standard_normal((k, max(b - a, 1)))[:, : b - a]
        out.append((slice(a, b), words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-12) / math.sqrt(BLOCKS)))
    return np.linalg.qr(rng.standard_normal((dim, dim)))[0], out


def threshold(dim: int, share: float) -> float:
    """Inner product that a random unit vector exceeds with a fixed direction in this share of cases."""
    t = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - t * t, 0) ** ((dim - 3) / 2) if dim > 3 else np.ones_like(t)
    above = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-above / above[0], -share)])


def _decode(x: np.ndarray, codes: list, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and direction numbers of all directions over the cut, or of the LEAST best ones where fewer are."""
    s = [x[:, part] @ words.T for part, words in codes]
    k = s[0].shape[1]
    top = s[2].max(axis=1)
    rows, found = [], []
    for i in range(len(x)):
        a = np.flatnonzero(s[0][i] >= cut - s[1][i].max() - top[i])
        pair = s[0][i, a][:, None] + s[1][i][None, :]
        p, q = np.nonzero(pair >= cut - top[i])
        third = np.sort(s[2][i])
        order = np.argsort(s[2][i], kind="stable")
        start = np.searchsorted(third, cut - pair[p, q])
        n = k - start
        at = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
        own = (np.repeat(a[p] * k + q, n)) * k + order[at]
        if len(own) < LEAST:  # the best sums are of each block's best
            u, v, w = (np.argsort(-b[i], kind="stable")[:LEAST] for b in s)
            sums = s[0][i, u][:, None, None] + s[1][i, v][:, None] + s[2][i, w]
            best = np.unravel_index(np.argsort(-sums, axis=None, kind="stable")[:LEAST], sums.shape)
            own = (u[best[0]] * k + v[best[1]]) * k + w[best[2]]
        found.append(own)
        rows.append(np.full(len(own), i))
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def random_pairs(n: int, dim: int, cosine: float, seed: int = 64064) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors in pairs of one cosine (of cosine 1 where there is a single dimension)."""
    x, y = np.random.Generator(np.random.PCG64(seed)).standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim < 2:
        return x, x
    y -= (x * y).sum(axis=1, keepdims=True) * x
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * y / np.linalg.norm(y, axis=1, keepdims=True)


def meets(x: np.ndarray, y: np.ndarray, k: int, cut: float, number: int) -> np.ndarray:
    """Whether each row of ``x`` shares a direction of the code with the same row of ``y``."""
    turn, codes = _codes(x.shape[1], k, number)
    (r, f), (q, g) = (_decode(v @ turn, codes, cut) for v in (x, y))
    out = np.zeros(len(x), bool)
    out[np.intersect1d(r * k**BLOCKS + f, q * k**BLOCKS + g) // k**BLOCKS] = True
    return out


def plan(dim: int, n: int) -> tuple[int, float, int]:
    """Codewords a block, threshold and number of codes for ``n`` vectors."""
    k = max(4, math.ceil((DIRECTIONS * n) ** (1 / BLOCKS)))
    cut = threshold(dim, min(0.5, FILTERS / k**BLOCKS))
    x, y = random_pairs(PAIRS, dim, MIN_COSINE)
    number, missed = 0, np.ones(PAIRS, bool)
    while missed.sum() > (1 - RECALL) * PAIRS:
        missed[missed] = ~meets(x[missed], y[missed], k, cut, number)
        number += 1
    return k, cut, number


def _filters(dim: int, k: int, cut: float, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [_codes(dim, k, c) for c in range(number)]
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                unit = _matrix(part.column("unit"))
                for c, (turn, blocks) in enumerate(codes):
                    rows, found = _decode(unit @ turn, blocks, cut)
                    yield pa.RecordBatch.from_arrays([pa.array(found * number + c, pa.int64()), part.column("class_id").take(pa.array(rows))], ["direction", "class_id"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = [np.rint(np.array(u) * 127).astype(np.int8).tobytes() for u in batch.column("unit").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array(sketch, pa.binary())], ["class_id", "sketch"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose cosine, with the most that rounding can take from it, reaches MIN_COSINE."""
    for batch in batches:
        left, right = batch.column("l_sketch").to_pylist(), batch.column("r_sketch").to_pylist()
        size = np.array([len(x) for x in left], np.int64)
        keep = np.zeros(len(size), bool)
        for dim in np.unique(size):
            own = np.flatnonzero(size == dim)
            x, y = (np.frombuffer(b"".join(v[i] for i in own), np.int8).reshape(-1, dim).astype(np.float64) / 127 for v in (left, right))
            off = math.sqrt(dim) * 0.5 / 127
            keep[own] = (x * y).sum(axis=1) >= MIN_COSINE - 2 * off - off * off - 1e-9
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = pa.array((_matrix(batch.column("l_unit")) * _matrix(batch.column("r_unit"))).sum(axis=1) >= MIN_COSINE)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Links of cosine >= 0.9 among all rows of ``vec_id``, ``embedding``.

    Returns ``vec_id``, ``n_links``, ``component_id``, ``kept`` (vec_id is its
    component's smallest), one row for each input row. Null, zero and
    non-finite vectors link with nothing and are their own component; a null
    vec_id stays null and is never kept; vectors of different lengths link
    with nothing of another length; copies and ties link with each other. An
    empty table gives an empty result. Other columns are ignored.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # by the largest component first, so that squares neither overflow nor vanish
    largest = F.aggregate("embedding", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.withColumn("largest", F.when(sound, largest)).withColumn("sound", F.coalesce(F.col("largest") > 0, F.lit(False)))
    scaled = F.transform("embedding", lambda x: x / F.col("largest"))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    classes = (
        rows.where("sound")
        .groupBy("embedding")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("largest").alias("largest"))
        .withColumn("scaled", scaled)
        .withColumn("norm", norm)
        .select(F.xxhash64("embedding").alias("hash"), "copies", "first_id", F.transform("scaled", lambda x: x / F.col("norm")).alias("unit"), "embedding")
    )
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "vectors")

    candidates = None
    for dim, n in classes.groupBy(F.size("unit")).count().orderBy("count").collect():  # one row for each length of vectors
        k, cut, number = plan(dim, n)
        own = classes.where(F.size("unit") == dim).select("class_id", "unit")
        near = own.repartition(max(12, n // 2000)).mapInArrow(_filters(dim, k, cut, number), "direction long, class_id long")
        near = near.select((F.col("direction") * 4096 + dim % 4096).alias("direction"), "class_id")
        candidates = near if candidates is None else candidates.unionByName(near)
    if candidates is None:
        candidates = vectors.sparkSession.createDataFrame([], "direction long, class_id long")
    candidates = materialize(candidates, "directions")
    pairs = (
        candidates.select("direction", F.col("class_id").alias("a"))
        .join(candidates.select("direction", F.col("class_id").alias("b")), "direction")
        .where("a < b")
        .select("a", "b")
        .distinct()
    )
    sketch = classes.select("class_id", "unit").mapInArrow(_sketches, "class_id long, sketch binary")
    pairs = pairs.join(sketch.select(F.col("class_id").alias("a"), F.col("sketch").alias("l_sketch")), "a").join(
        sketch.select(F.col("class_id").alias("b"), F.col("sketch").alias("r_sketch")), "b"
    )
    pairs = materialize(pairs.where("octet_length(l_sketch) = octet_length(r_sketch)").mapInArrow(_likely, "a long, b long"), "likely_pairs")
    unit = classes.select("class_id", "unit")
    both = pairs.join(unit.select(F.col("class_id").alias("a"), F.col("unit").alias("l_unit")), "a").join(
        unit.select(F.col("class_id").alias("b"), F.col("unit").alias("r_unit")), "b"
    )
    links = materialize(both.where("size(l_unit) = size(r_unit)").mapInArrow(_cosines, "a long, b long"), "vector_links")

    labels = connected_components(links, "a", "b")
    copies = classes.select("class_id", "copies")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(copies.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("copies").alias("others"))
    placed = classes.select("class_id", "copies", "first_id", "embedding").join(degree, "class_id", "left").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    placed = placed.withColumn("part", F.coalesce("component", "class_id"))
    lowest = placed.groupBy("part").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(lowest, "part").select(
        "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"
    )
    linked = rows.where("sound").select("vec_id", "embedding").join(placed, "embedding").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
