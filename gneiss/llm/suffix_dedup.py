"""Exact substring dedup by sampled suffixes in sorted buckets.

Every byte that a 100-byte string covers which also starts earlier is removed.
Comparing the suffix at every byte would move hundreds of bytes for each byte
of text. Instead each 100-byte string is represented by one suffix inside it:
the one whose 50 leading bytes have the smallest hash (of which half the bits
count; the leftmost of equal ones). The choice depends on the string alone, so equal strings are
represented by equal suffixes at the same place, and about one suffix in 26 is
kept; neighbouring strings that share their suffix are a run.

1. Suffixes are ordered by their eight leading bytes and then by the hash of
   their 50 leading bytes, dealt by range between splitters taken from a
   sample, and sorted in their bucket; those that occur once are dropped. A
   suffix so frequent that several splitters equal it is dealt over all their
   buckets; the last suffix of a bucket is compared with the first of the
   next, so none is lost at a boundary.
2. The suffixes left come with the bytes around them that their run covers,
   and are dealt in the same way. Runs of equal bytes repeat as a whole. Runs
   that differ are compared string by string: their 100-byte strings are
   sorted by multikey quicksort, eight bytes at a time, equal keys only going
   on to the next eight.
3. Where the runs of one suffix are in several buckets or blocks, each block
   sends on its distinct strings, and the bytes themselves are grouped across
   blocks with partial minima.

Copies of a whole text are one class: only the first is compared. A class is
numbered by a 64-bit hash; should two texts ever share it (their SHA-256
differ), they are numbered by another hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as T
from gneiss.llm.sieve import passes, sieve
from gneiss.sources.storage import materialize

LENGTH = 100
#: Leading bytes of a suffix that are hashed, and places of such a string in one of LENGTH bytes.
LEAD = 50
PLACES = LENGTH - LEAD + 1
#: Documents that splitters are sampled from, at least; suffixes of a bucket, and buckets at most.
SAMPLE_DOCS = 1_000
BUCKET, MAX_BUCKETS = 250_000, 1 << 17
#: Strings that a task compares at once.
BLOCK_STRINGS = 500_000
#: Bytes of text that a task turns into suffixes at once.
SLICE_BYTES = 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def class_of(text: bytes, clashes: frozenset[int] = frozenset()) -> int:
    """Number of a text: a 64-bit hash, or another one for texts whose first is in ``clashes``."""
    own = int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))
    return int(np.uint64(xxhash.xxh64_intdigest(text, 7)).astype(np.int64)) if own in clashes else own


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, suffix, first and last string (byte positions) of each run, and the suffix's eight leading bytes and hash of LEAD bytes."""
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    lead = T.window_hashes(data, LEAD)
    # half of the hash above the place: the least is the leftmost of the smallest
    low = (lead & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(lead), dtype=np.uint64)
    width = 1
    while width * 2 <= PLACES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = PLACES - width
    at = (np.minimum(low[: len(low) - rest], low[rest:])[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[:n] == row[LENGTH - 1 :]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:n] != row[: n - 1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    last = np.flatnonzero(whole & np.concatenate((new[1:] | ~whole[1:], [True])))
    suffix = at[first]
    head = np.zeros(len(suffix), np.uint64)
    for j in range(8):
        head = (head << np.uint64(8)) | data[suffix + j]
    return row[first], suffix, first, last, head, lead[suffix]


def _ordered(head: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Suffixes as byte strings that compare as (leading bytes, hash)."""
    return np.ascontiguousarray(np.stack((head, mark), axis=1).astype(">u8")).view("S16").ravel()


def _buckets(splitters: np.ndarray, head: np.ndarray, mark: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each suffix, and whether its equals are in several buckets."""
    heads = splitters.view(">u8")[::2].astype(np.uint64)
    low = np.searchsorted(heads, head, "left")
    high = np.searchsorted(heads, head, "right")
    tied = np.flatnonzero(high > low)  # only these need their hash compared
    key = _ordered(head[tied], mark[tied])
    low[tied], high[tied] = np.searchsorted(splitters, key, "left"), np.searchsorted(splitters, key, "right")
    hot = high - low > 1
    spread = (T.mix(classes.view(np.uint64)) % np.maximum(high - low, 1).astype(np.uint64)).astype(np.int64)
    return np.where(hot, low + 1 + spread, high).astype(np.int32), hot


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as longs of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _classes(clashes: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([class_of(t, clashes) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                ],
                ["doc_id", "n_bytes", "class_id", "sha256"],
            )

    return run


_SUFFIX = "bucket int, head long, mark long, class_id long, place int"


def _suffixes(splitters: np.ndarray, clashes: frozenset[int]):
    """Suffixes of each class that a task meets, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a number for each text of this task's input
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            for a, b in T.slices(offsets, SLICE_BYTES):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                raw = own.tobytes()
                classes = [class_of(raw[x:y], clashes) for x, y in zip(at[:-1], at[1:], strict=True)]
                new = np.fromiter((not (c in seen or seen.add(c)) for c in classes), bool, len(classes))
                row, suffix, _, _, head, mark = runs(own, at)
                keep = new[row]
                row, suffix, head, mark = row[keep], suffix[keep], head[keep], mark[keep]
                owner = np.array(classes, np.int64)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_buckets(splitters, head, mark, owner)[0]), pa.array(_signed(head)), pa.array(_signed(mark)), pa.array(owner), pa.array(suffix - at[row], pa.int32())],
                    ["bucket", "head", "mark", "class_id", "place"],
                )

    return run


_AGAIN = "class_id long, place int, part int, head long, mark long, single boolean"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's sorted suffixes, those that the one before or after equals; the first and the last with their bucket, to be compared across boundaries."""
    names = ["class_id", "place", "part", "head", "mark", "single"]
    part, held, first = TaskContext.get().partitionId(), None, True

    def rows(table: pa.Table, edge: bool, single: bool) -> pa.RecordBatch:
        none = [pa.nulls(table.num_rows, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.bool_())]
        if edge:
            none = [pa.array([part], pa.int32()), table.column("head").combine_chunks(), table.column("mark").combine_chunks(), pa.array([single])]
        return pa.RecordBatch.from_arrays([table.column("class_id").combine_chunks(), table.column("place").combine_chunks(), *none], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held[0].to_batches(), batch])
        head, mark = table.column("head").to_numpy(), table.column("mark").to_numpy()
        same = (head[1:] == head[:-1]) & (mark[1:] == mark[:-1])
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if held is not None:
            keep[0] |= held[1]
        if first and len(head) > 1:
            yield rows(table.slice(0, 1), True, not keep[0])
            first = False
        yield rows(table.slice(0, len(head) - 1).filter(pa.array(keep[:-1])), False, False)
        held = (table.slice(len(head) - 1).combine_chunks(), bool(keep[-1]))
    if held is not None:
        yield rows(held[0], True, not held[1])
        if held[1]:
            yield rows(held[0], False, False)


def _across(again: DataFrame) -> DataFrame:
    """``class_id``, ``place`` of the suffixes that repeat in their bucket or over a boundary."""
    edges = again.where("part is not null")
    shared = edges.groupBy("head", "mark").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    late = edges.where("single").join(shared, ["head", "mark"], "left_semi").select("class_id", "place")
    return again.where("part is null").select("class_id", "place").unionByName(late)


def _texts(wanted, clashes: frozenset[int]):
    """Text of each class in the sieve, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            classes = np.array([class_of(t, clashes) for t in texts], np.int64)
            keep = [i for i in np.flatnonzero(passes(wanted.value, classes)).tolist() if not (int(classes[i]) in seen or seen.add(int(classes[i])))]
            yield pa.RecordBatch.from_arrays([pa.array(classes[keep], pa.int64()), pa.array([texts[i] for i in keep], pa.binary())], ["class_id", "bytes"])

    return run


_CONTEXT = "bucket int, hot boolean, head long, mark long, first_id long, class_id long, start int, bytes binary"


def _contexts(splitters: np.ndarray):
    """Runs of the repeated suffixes with the bytes that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("bytes")
            ends = np.concatenate(([0], np.cumsum([len(t.as_buffer()) for t in texts], dtype=np.int64)))
            for a, b in T.slices(ends, SLICE_BYTES):
                part = batch.slice(a, b - a)
                raw, at = b"".join(t.as_buffer() for t in part.column("bytes")), ends[a : b + 1] - ends[a]
                row, suffix, first, last, head, mark = runs(np.frombuffer(raw, np.uint8), at)
                lists = part.column("places")
                places = np.repeat(at[:-1], pc.list_value_length(lists).to_numpy()) + lists.flatten().to_numpy()
                keep = np.isin(suffix, places)
                row, first, last, head, mark = row[keep], first[keep], last[keep], head[keep], mark[keep]
                owner = part.column("class_id").take(pa.array(row))
                bucket, hot = _buckets(splitters, head, mark, owner.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket), pa.array(hot), pa.array(_signed(head)), pa.array(_signed(mark)), part.column("first_id").take(pa.array(row)), owner,
                        pa.array(first - at[row], pa.int32()), pa.array([raw[x : y + LENGTH] for x, y in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()),
                    ],
                    ["bucket", "hot", "head", "mark", "first_id", "class_id", "start", "bytes"],
                )

    return run


def _multikey(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Number of the class of equal LENGTH-byte strings at ``at`` (of one group), -1 for single ones."""
    out = np.full(len(at), -1, np.int64)
    live = np.arange(len(at))
    part = group.astype(np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    for d in range(0, LENGTH, 8):
        n = min(8, LENGTH - d)
        word = np.zeros(len(live), np.uint64)
        for j in range(n):
            word = (word << np.uint64(8)) | padded[at[live] + d + j]
        order = np.lexsort((word, part))
        live, word, part = live[order], word[order], part[order]
        new = np.ones(len(live), bool)
        new[1:] = (word[1:] != word[:-1]) | (part[1:] != part[:-1])
        number = np.cumsum(new) - 1
        keep = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        live, part = live[keep], number[keep]
    out[live] = part
    return out


_FOUND = pa.schema([("class_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("string", pa.binary()), ("first_id", pa.int64())])


def _compare(rows: list[tuple]) -> pa.RecordBatch:
    """Strings of distinct runs that repeat, as intervals; of runs that may have equals elsewhere, each distinct string too.

    rows: (group, elsewhere, first_id, class_id, start, bytes) in order of
    document and place within a group.
    """
    if not rows:
        return pa.RecordBatch.from_pylist([], _FOUND)
    sizes = np.array([len(r[5]) for r in rows])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    raw = b"".join(r[5] for r in rows)
    strings = sizes - LENGTH + 1
    run = np.repeat(np.arange(len(rows)), strings)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(strings) - strings, strings)
    equal = _multikey(np.frombuffer(raw, np.uint8), base[run] + nth, np.array([r[0] for r in rows])[run])
    again = np.zeros(len(run), bool)
    known = np.flatnonzero(equal >= 0)
    # rows are in order, so the first of each class of equal strings is the original
    _, original = np.unique(equal[known], return_index=True)
    again[known] = True
    again[known[original]] = False
    at = np.flatnonzero(again)
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (run[at[1:]] != run[at[:-1]])))) if len(at) else at
    first, last = at[cut], at[[*(cut[1:] - 1), len(at) - 1]] if len(at) else at
    sent = np.flatnonzero(~again & np.array([r[1] for r in rows])[run])
    from_row = np.concatenate((run[first], run[sent]))
    first_id, class_id, start = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
    begin = start[from_row] + np.concatenate((nth[first], nth[sent]))
    end = start[from_row] + np.concatenate((nth[last], nth[sent]))
    text = [None] * len(first) + [raw[x : x + LENGTH] for x in (base[run[sent]] + nth[sent]).tolist()]
    return pa.RecordBatch.from_arrays([pa.array(class_id[from_row]), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.binary()), pa.array(first_id[from_row])], schema=_FOUND)


def _judged(block_strings: int):
    """Repeated strings of sorted runs as intervals; distinct strings of suffixes whose runs are in several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []  # whole groups, then the rows of the group at hand
        group, number, known, waiting, whole, elsewhere = None, 0, set(), 0, 0, False
        for batch in batches:
            copies = {"class_id": [], "first": [], "last": []}
            columns = [batch.column(c).to_pylist() for c in ("hot", "head", "mark", "first_id", "class_id", "start", "bytes")]
            for hot, head, mark, first_id, class_id, start, text in zip(*columns, strict=True):
                if (head, mark) != group:
                    if len(block) - whole == 1 and not elsewhere:
                        waiting -= len(block.pop()[5]) - LENGTH + 1  # nothing to compare it with
                    group, number, known, whole, elsewhere = (head, mark), number + 1, set(), len(block), hot
                if text in known:
                    copies["class_id"].append(class_id)
                    copies["first"].append(start)
                    copies["last"].append(start + len(text) - LENGTH)
                    continue
                if waiting >= block_strings:
                    if len(block) > whole:  # the group goes on in the next block
                        elsewhere = True
                        block[whole:] = [(r[0], True, *r[2:]) for r in block[whole:]]
                    yield _compare(block)
                    block, known, waiting, whole = [], set(), 0, 0
                known.add(text)
                block.append((number, elsewhere, first_id, class_id, start, text))
                waiting += len(text) - LENGTH + 1
            n = len(copies["class_id"])
            yield pa.RecordBatch.from_arrays([pa.array(copies["class_id"], pa.int64()), pa.array(copies["first"], pa.int32()), pa.array(copies["last"], pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=_FOUND)
        yield _compare(block)

    return run


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"class_id": batch.column("class_id").to_pylist(), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for text, spans in zip(batch.column("bytes"), batch.column("spans"), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                steps = np.zeros(len(raw) + 1, np.int32)
                first, last = (spans.values.field(i).to_numpy() for i in (0, 1))
                np.add.at(steps, first, 1)
                np.add.at(steps, last + LENGTH, -1)
                gone = np.cumsum(steps)[:-1] > 0
                kept = raw[~gone].tobytes()
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1)))
                out["kept_sha256"].append(hashlib.sha256(kept).digest())
                out["kept"].append(kept if keep_text else None)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("class_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.binary()), ("kept", pa.binary())]))

    return run


def _members(docs: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """``doc_id``, ``n_bytes``, ``class_id``, ``sha256`` of every row, and the class numbers that texts shared at first."""
    clashes: frozenset[int] = frozenset()
    while True:
        members = materialize(docs.mapInArrow(_classes(clashes), "doc_id long, n_bytes long, class_id long, sha256 binary"), "texts")
        shared = members.groupBy("class_id").agg(F.min("sha256").alias("low"), F.max("sha256").alias("high")).where("low <> high")
        # texts that share a 64-bit hash: a handful among 10**10
        found = frozenset(r[0] for r in shared.select("class_id").collect())
        if not found:
            return members, clashes
        clashes |= found


def dedup_substrings(docs: DataFrame, keep_text: bool = False, bucket: int = BUCKET, block_strings: int = BLOCK_STRINGS) -> DataFrame:
    """Bytes of every whole text left after repeated 100-byte strings are removed.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` (and ``kept``, the bytes themselves, with ``keep_text``),
    one row for each input row. Null texts are empty. Earlier means a smaller
    doc_id, then an earlier place; null doc_ids come last; rows that repeat one
    doc_id and text are one document, and of different texts under one doc_id
    the order is by a hash of the text. Texts shorter than 100 bytes stay.
    An empty table gives an empty result. Other columns are ignored.
    ``bucket`` (suffixes) and ``block_strings`` bound what a task sorts and
    compares at once; they never change the result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = docs.select("text")
    members, clashes = _members(docs)
    classes = members.groupBy("class_id").agg(F.min("doc_id").alias("least_id"), F.first("n_bytes").alias("n_bytes"))
    total = classes.agg(F.sum("n_bytes")).first()[0] or 0

    n = int(max(16, min(total // 26 // bucket, MAX_BUCKETS)))
    # bounded: suffixes of at most max(SAMPLE_DOCS, n) documents, thinned to about 64 for each bucket
    chosen = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(SAMPLE_DOCS, n))
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")
    sample = sample.mapInArrow(_suffixes(np.zeros(0, "S16"), clashes), _SUFFIX).orderBy(F.xxhash64("class_id", "place"), "class_id", "place").limit(64 * n).select("head", "mark").toArrow()
    sample = np.sort(_ordered(*(sample.column(c).to_numpy().view(np.uint64) ^ np.uint64(1 << 63) for c in ("head", "mark"))))
    splitters = sample[(np.arange(1, n) * len(sample)) // n] if len(sample) else sample

    suffixes = source.mapInArrow(_suffixes(splitters, clashes), _SUFFIX)
    suffixes = suffixes.repartitionById(n, "bucket").sortWithinPartitions("head", "mark").select("head", "mark", "class_id", "place")
    again = _across(materialize(suffixes.mapInArrow(_repeated, _AGAIN), "suffixes"))
    places = materialize(again.groupBy("class_id").agg(F.collect_set("place").alias("places")), "places")

    wanted = sieve(places, "class_id")
    texts = source.mapInArrow(_texts(wanted, clashes), "class_id long, bytes binary")
    known = places.join(classes.select("class_id", F.coalesce("least_id", F.lit(2**63 - 1)).alias("first_id")), "class_id")
    texts = texts.join(known, "class_id").dropDuplicates(["class_id"])
    contexts = texts.mapInArrow(_contexts(splitters), _CONTEXT)
    contexts = contexts.repartitionById(n, "bucket").sortWithinPartitions("head", "mark", "first_id", "class_id", "start")
    found = materialize(contexts.drop("bucket").mapInArrow(_judged(block_strings), "class_id long, first int, last int, string binary, first_id long"), "repeats")
    wanted.unpersist()
    single = found.where("string is not null")
    order = F.struct("first_id", "class_id", "first")
    least = single.groupBy("string").agg(F.min(order).alias("least"))
    later = single.join(least, "string").where(order > F.col("least")).select("class_id", "first", "last")
    spans = found.where("string is null").select("class_id", "first", "last").unionByName(later)
    spans = materialize(spans.groupBy("class_id").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")

    touched = source.mapInArrow(_texts(sieve(spans, "class_id"), clashes), "class_id long, bytes binary").join(spans, "class_id").dropDuplicates(["class_id"])
    cut = touched.select("class_id", "bytes", "spans").mapInArrow(_cut(keep_text), "class_id long, n_removed long, n_spans long, kept_sha256 binary, kept binary")
    cut = cut if keep_text else cut.drop("kept")
    rows = members.join(classes.select("class_id", "least_id"), "class_id").join(cut, "class_id", "left")
    copy = (F.col("n_bytes") >= LENGTH) & F.coalesce(F.coalesce("doc_id", F.lit(2**63 - 1)) > F.col("least_id"), F.lit(False))
    out = rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.lower(F.hex(F.coalesce("kept_sha256", "sha256")))).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "class_id"] if keep_text else []),
    )
    if not keep_text:
        return out
    whole = source.mapInArrow(_texts(sieve(members, "class_id"), clashes), "class_id long, bytes binary").dropDuplicates(["class_id"])
    return out.join(whole, "class_id", "left").withColumn("kept", F.coalesce("kept", "bytes")).drop("class_id", "bytes")
