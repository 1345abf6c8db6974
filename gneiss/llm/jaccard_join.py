"""N-gram Jaccard join by parity sketches.

Each document is its set of distinct five-word shingles. Within a size band
every shingle flips one bit of a very wide parity sketch, so the Hamming
distance of two sketches is at most the symmetric difference of the sets. Two
sets of at most r shingles with Jaccard >= 0.8 differ in at most D = 2r/9
shingles; a sketch cut into D+1+e pieces therefore has at least 1+e pieces
without a difference. A piece is kept as the XOR of its shingles' hashes,
which equals in equal pieces, and pieces are the join keys.

Empty pieces are equal in unrelated documents and give no key. A document
with so many empty pieces that they could hide all its equal ones also gives
the keys of the classic prefix filter (its few smallest shingle hashes),
which finds any partner of that kind exactly.

Copies (equal sets) are one class throughout. Within a key's rows every class
is first checked against one representative, then where components still
differ against another few, so a group of near copies costs a few stars and not
a square. What is then still in different components is compared
pairwise under small keys. A large key of unlike classes comes from a passage
that many documents share; a similar pair with no small key in common would
have to share ``need`` large ones, so classes with fewer large keys leave those
before their pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm import text as T
from gneiss.llm.sieve import passes, sieve
from gneiss.operators.graph import connected_components
from gneiss.sources.storage import materialize

WORDS = 5
#: Similarity of linked documents: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Upper sizes of the bands grow by this factor.
BAND_RATIO = 1.6
#: Times that classes of a key are checked against another representative before they meet pairwise.
STAR_ROUNDS = 3
#: Keys of more classes than this are large.
LARGE_KEY = 64
#: 64-bit words of the short parity sketch that sieves pairs before their sets are compared.
SKETCH = [f"s{i}" for i in range(8)]


def bands(largest: int) -> np.ndarray:
    """Largest set size of each band, up to ``largest``."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return np.array(out, np.int64)


def _difference(size: np.ndarray) -> np.ndarray:
    """Most shingles in which two similar sets of at most ``size`` can differ."""
    return 2 * size * (100 - PERCENT) // (100 + PERCENT)


def _keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join keys of each row, their rows and tags; hashes are sorted within a row.

    A tag is 64 * need + scheme: two similar rows share at least ``need`` keys
    of one scheme, or (scheme 63, the prefix filter) one.
    """
    size = np.diff(offsets)
    tops = bands(int(size.max(initial=1)) * 2)
    band = np.searchsorted(tops, size)
    keys, rows, tags = [], [], []
    crowded = np.zeros(len(size), bool)
    for step in (0, 1):
        use = size > 0
        if step:  # partners of up to 1.25 times the size may be a band above
            use &= size * 100 // PERCENT > tops[band]
        differ = _difference(tops[np.minimum(band + step, len(tops) - 1)])
        use &= differ > 0
        pieces = np.where(use, differ + 2 + differ // 8, 0)
        row = np.repeat(np.arange(len(size)), np.where(use, size, 0))
        if not len(row):
            continue
        own = hashes[np.repeat(use, size)]
        scheme = T.mix((band + step + 1).astype(np.uint64) * np.uint64(0x51ED270B))
        piece = ((T.mix(own ^ scheme[row]) >> np.uint64(32)) * pieces[row].astype(np.uint64)) >> np.uint64(32)
        slot = np.concatenate(([0], np.cumsum(pieces)))[row] + piece.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, own, row, piece = slot[order], own[order], row[order], piece[order]
        head = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        parity = np.bitwise_xor.reduceat(T.mix(own), head)
        keys.append(T.mix(parity ^ T.mix(piece[head] + scheme[row[head]])))
        rows.append(row[head])
        filled = np.bincount(row[head], minlength=len(size))
        crowded |= use & (filled <= differ)
        tags.append((np.maximum(filled - differ, 1) * 64 + np.minimum(band + step, 62))[row[head]])
    if crowded.any():
        prefix = size - (size * PERCENT + 99) // 100 + 1
        row = np.repeat(np.arange(len(size)), np.where(crowded, prefix, 0))
        nth = np.arange(len(row)) - np.repeat(np.cumsum(np.where(crowded, prefix, 0)) - np.where(crowded, prefix, 0), np.where(crowded, prefix, 0))
        keys.append(T.mix(hashes[offsets[:-1][row] + nth] ^ np.uint64(0xD6E8FEB86659FD93)))
        rows.append(row)
        tags.append(np.full(len(row), 127))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(tags)


def _parity(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Short parity sketch of each row: each shingle flips one of its bits."""
    bit = T.mix(hashes ^ np.uint64(0x8BB84B93962EACC9)) % np.uint64(64 * len(SKETCH))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros((len(offsets) - 1, len(SKETCH)), np.uint64)
    np.bitwise_xor.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _wide(hashes: np.ndarray) -> bytes:
    """Parity sketch of as many bits as there are shingles (a power of two)."""
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    slot = (T.mix(hashes ^ np.uint64(0x3C79AC492BA7B653)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        for a, b in T.slices(offsets):
            hashes, at = T.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS)
            sketch = _parity(hashes, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[a:b], batch.column("text_key")[a:b], pa.array(np.diff(at), pa.int64()), T.signed(T.set_hash(hashes, at)), *(T.signed(x.copy()) for x in sketch.T), pa.array([_wide(hashes[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "class_id", *SKETCH, "wide"],
            )


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # classes of this task
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        for a, b in T.slices(offsets):
            hashes, at = T.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS)
            classes = T.set_hash(hashes, at)
            new = np.fromiter((not (c in seen or seen.add(c)) for c in classes.tolist()), bool, len(classes))
            keys, rows, tags = _keys(hashes[np.repeat(new, np.diff(at))], np.concatenate(([0], np.cumsum(np.diff(at)[new]))))
            yield pa.RecordBatch.from_arrays([T.signed(keys), T.signed(classes[new][rows]), pa.array(tags, pa.int32())], ["key", "class_id", "tag"])


def _sets(wanted):
    """Shingle sets of the documents whose class is in the sieve, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            for a, b in T.slices(offsets):
                hashes, at = T.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS)
                classes = T.set_hash(hashes, at)
                keep = [i for i in np.flatnonzero(passes(wanted.value, classes)) if not (int(classes[i]) in seen or seen.add(int(classes[i])))]
                if keep:
                    yield pa.RecordBatch.from_arrays(
                        [T.signed(classes[keep]), pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in keep], pa.binary())], ["class_id", "shingles"]
                    )

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)):
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= PERCENT * (len(both) - shared)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _near_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their wide sketches don't rule out; the longer one is folded."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        sizes = (batch.column("l_size").to_numpy() + batch.column("r_size").to_numpy()).tolist()
        for i, (x, y, size) in enumerate(zip(batch.column("l_wide"), batch.column("r_wide"), sizes, strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            n = min(len(x), len(y))
            gap = np.bitwise_xor.reduce(x.reshape(-1, n)) ^ np.bitwise_xor.reduce(y.reshape(-1, n))
            keep[i] = (100 + PERCENT) * int(np.bitwise_count(gap).sum()) <= (100 - PERCENT) * size
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose exact Jaccard similarity is high enough."""
    wide = sketches.select("class_id", "size", "wide")
    near = pairs.join(_side(wide, "l_").withColumnRenamed("l_class_id", "a"), "a").join(_side(wide, "r_").withColumnRenamed("r_class_id", "b"), "b")
    pairs = materialize(near.mapInArrow(_near_sketches, "a long, b long"), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    wanted = sieve(ids, "class_id")
    found = docs.select("text").mapInArrow(_sets(wanted), "class_id long, shingles binary")
    sets = materialize(found.join(ids, "class_id", "left_semi").dropDuplicates(["class_id"]), "sets")
    wanted.unpersist()
    both = (
        pairs.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("right")), "b")
    )
    return materialize(both.select("a", "b", "left", "right").mapInArrow(_similar, "a long, b long"), "links")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the keys whose classes are not all in one component yet."""
    key = Window.partitionBy("key")
    placed = buckets.select("key", "class_id", "tag").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "class_id"))
    wide = placed.withColumn("low", F.min("component").over(key)).withColumn("high", F.max("component").over(key)).withColumn("n", F.count("*").over(key))
    return wide.where("low <> high").select("key", "class_id", "tag", "component", "n")


def _may_link() -> str:
    """Sizes and short sketches of l_ and r_ columns don't rule a link out."""
    sizes = f"100 * least(l_size, r_size) >= {PERCENT} * greatest(l_size, r_size)"
    hamming = " + ".join(f"bit_count(l_{c} ^ r_{c})" for c in SKETCH)
    return f"{sizes} and {100 + PERCENT} * ({hamming}) <= {100 - PERCENT} * (l_size + r_size)"


def _side(rows: DataFrame, prefix: str, *keys: str) -> DataFrame:
    return rows.select(*(F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in rows.columns))


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of each class of a key and one class, drawn by hash, of the key's largest component."""
    rows = rows.withColumn("part_n", F.count("*").over(Window.partitionBy("key", "component")))
    key = Window.partitionBy("key").orderBy(F.desc("part_n"), F.xxhash64("class_id", F.lit(turn)), "class_id")
    centre = F.first(F.struct(*(c for c in rows.columns if c not in ("key", "tag", "n")))).over(key)
    both = rows.withColumn("centre", centre).where("component <> centre.component and class_id <> centre.class_id")
    left = [F.col(c).alias(f"l_{c}") for c in rows.columns if c in ("class_id", "size", *SKETCH)]
    both = both.select(*left, *(F.col(f"centre.{c}").alias(f"r_{c}") for c in rows.columns if c in ("class_id", "size", *SKETCH))).where(_may_link())
    return both.select(F.greatest("l_class_id", "r_class_id").alias("a"), F.least("l_class_id", "r_class_id").alias("b")).distinct()


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of classes of one key that are in different components and may link."""
    both = _side(rows, "l_", "key").join(_side(rows, "r_", "key"), "key")
    apart = "l_class_id > r_class_id and l_component <> r_component"
    return both.where(f"{apart} and {_may_link()}").select(F.col("l_class_id").alias("a"), F.col("r_class_id").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate components of ``doc_id``, ``text``.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (the smallest doc_id
    that links reach, itself included) and ``text_key`` (``xxhash64(text)``,
    which tells texts of one doc_id apart), one row for each input row. Null and
    empty texts have no shingles and link with nothing; equal sets always
    link; repeated rows of one doc_id give repeated rows. Texts may have any
    length and are used whole. Other columns are ignored. An empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    members = materialize(keyed.mapInArrow(_classes, "doc_id long, text_key long, n_shingles long, class_id long, " + ", ".join(f"{c} long" for c in SKETCH) + ", wide binary"), "classes")
    lowest = members.where("n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("first_id"))

    key = Window.partitionBy("key")
    keys = docs.select("text").mapInArrow(_sketches, "key long, class_id long, tag int")
    buckets = materialize(
        keys.withColumn("rep", F.min("class_id").over(key)).withColumn("top", F.max("class_id").over(key)).where("rep <> top").drop("top").distinct(), "buckets"
    )
    sketches = members.where("n_shingles > 0").select("class_id", F.col("n_shingles").alias("size"), *SKETCH, "wide").dropDuplicates(["class_id"])
    stars = buckets.where("class_id <> rep").select(F.col("class_id").alias("l_class_id"), F.col("rep").alias("r_class_id")).distinct()
    stars = stars.join(_side(sketches.drop("wide"), "l_"), "l_class_id").join(_side(sketches.drop("wide"), "r_"), "r_class_id").where(_may_link())
    stars = materialize(stars.select(F.col("l_class_id").alias("a"), F.col("r_class_id").alias("b")), "stars")
    links = _verified(stars, sketches, docs)
    labels = connected_components(links, "a", "b")

    short, tested = sketches.drop("wide"), stars
    mixed = materialize(_mixed(buckets, labels).join(short, "class_id"), "mixed")
    for turn in range(STAR_ROUNDS):
        more = materialize(_stars(mixed, turn).join(tested, ["a", "b"], "left_anti"), "stars")
        found = _verified(more, sketches, docs)
        tested = tested.unionByName(more)
        if not found.limit(1).count():
            break  # what another representative would bring, the pairwise step finds as well
        links = links.unionByName(found)
        labels = connected_components(links, "a", "b")
        mixed = materialize(_mixed(mixed, labels).join(short, "class_id"), "mixed")
    pairs = _pairs(mixed.where(F.col("n") <= LARGE_KEY))
    large = mixed.where(F.col("n") > LARGE_KEY)
    enough = large.groupBy("class_id", "tag").count().where("count * 64 + 63 >= tag").drop("count")
    pairs = pairs.unionByName(_pairs(large.join(enough, ["class_id", "tag"], "left_semi")))
    rest = materialize(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        links = links.unionByName(_verified(rest, sketches, docs))
        labels = connected_components(links, "a", "b")

    reach = (
        labels.withColumnRenamed("node", "class_id").join(lowest, "class_id").withColumn("lowest_id", F.min("first_id").over(Window.partitionBy("component")))
    )
    ends = lowest.join(reach.select("class_id", "lowest_id"), "class_id", "left").select("class_id", F.coalesce("lowest_id", "first_id").alias("component_id"))
    linked = members.where("n_shingles > 0").join(ends, "class_id").select("doc_id", "n_shingles", "component_id", "text_key")
    alone = members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key")
    return linked.unionByName(alone)
