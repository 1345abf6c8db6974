"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so the packing problem is the
histogram of lengths (at most ``capacity`` numbers), whatever the number of
documents. Bin completion branches over the fillings of the largest length
left, least waste and largest parts first: sums that lengths still in stock can
reach say which wastes there are, fillings that a length in stock still fits
into are dominated and left out, and each filling is repeated any number of
times the stock allows, most first. A branch ends where its sequences and the
least that the rest needs reach the incumbent, at first the better of
best-fit decreasing and the path of first choices. Branches with few other than
first choices come first, those with an early one before those with a late one.
The search ends with a proof, or after NODES fillings with the best plan found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.sources.storage import materialize

CAPACITY = 1024
#: Id that ends each document.
END = 2
#: Nodes and fillings that the branch and bound looks at, at most.
NODES = 20_000
#: Salts that deal the pieces of one length, and those of full length, over tasks.
SALTS, FULL_SALTS = 64, 4096


@cache
def _encoder(path: str):
    """The tokenizer file's vocabulary in the faster of the two BPE libraries."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]
    if any(spec["model"]["vocab"][m] != 256 + i for i, m in enumerate(merged)):
        raise ValueError("ids don't follow the order of merges, which the faster library takes them for")
    ranks = {bytes(char[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    # fixed value: the byte-level splitting pattern of this kind of vocabulary
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = encoder.encode_to_numpy(text.as_py() or "", allowed_special="all")
                ids = np.append(ids.astype("<u4"), np.uint32(END))
                head = len(ids) % capacity or capacity
                at = [0, *range(head, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


Pattern = tuple[dict[int, int], int]


def _reach(stock: np.ndarray, parts: list[int], space: int) -> list[int]:
    """Bit s of number i: the sum s can be reached with the first i parts."""
    reach, keep = [1], (1 << (space + 1)) - 1
    for x in parts:
        sums, left, k = reach[-1], min(int(stock[x]), space // x), 1
        while left:
            take = min(k, left)
            sums |= (sums << (take * x)) & keep
            left -= take
            k *= 2
        reach.append(sums)
    return reach


def _fillings(stock: np.ndarray, largest: int, capacity: int) -> Iterator[dict[int, int] | None]:
    """Undominated sequences with a piece of ``largest``, least waste and largest parts first; None for a dominated one."""
    stock = stock.copy()
    stock[largest] -= 1
    space = capacity - largest
    parts = [x for x in range(1, min(space, largest) + 1) if stock[x]]
    reach = _reach(stock, parts, space)

    def exact(i: int, need: int) -> Iterator[dict[int, int]]:
        if not need:
            yield {}
            return
        for j in range(i, 0, -1):  # the largest part taken
            if not reach[j] >> need & 1:
                return
            x = parts[j - 1]
            for n in range(min(int(stock[x]), need // x), 0, -1):
                if reach[j - 1] >> (need - n * x) & 1:
                    for rest in exact(j - 1, need - n * x):
                        yield {x: n} | rest

    for total in range(space, -1, -1):
        if reach[-1] >> total & 1:
            for filling in exact(len(parts), total):
                if any(stock[x] > filling.get(x, 0) for x in parts if x <= space - total):
                    yield None
                else:
                    yield filling | {largest: filling.get(largest, 0) + 1}


def _times(most: int) -> Iterator[int]:
    """Every number from 1 to ``most``: the most, then halves, quarters and so on."""
    seen, parts = set(), 1
    while len(seen) < most:
        for i in range(parts, 0, -1):
            t = -(-most * i // parts)
            if t not in seen:
                seen.add(t)
                yield t
        parts *= 2


def _without(stock: np.ndarray, pattern: dict[int, int], times: int) -> np.ndarray:
    stock = stock.copy()
    for x, n in pattern.items():
        stock[x] -= n * times
    return stock


def _completion(stock: np.ndarray, capacity: int) -> list[Pattern]:
    """The path of first choices."""
    out = []
    for largest in range(capacity, 0, -1):
        while stock[largest]:
            pattern = next(f for f in _fillings(stock, largest, capacity) if f)
            times = min(int(stock[x]) // n for x, n in pattern.items())
            stock = _without(stock, pattern, times)
            out.append((pattern, times))
    return out


def branch_and_bound(stock: np.ndarray, capacity: int, best: list[Pattern], budget: int = NODES) -> tuple[list[Pattern], bool]:
    """A plan of fewer sequences than ``best`` if the search finds one, and whether the plan is proven to be the shortest."""
    length = np.arange(capacity + 1)
    parts = [x for x in range(1, capacity + 1) if stock[x]]
    fullest = max(1, _reach(stock, parts, capacity)[-1].bit_length() - 1)
    half = capacity // 2 + 1
    fewest = sum(times for _, times in best)

    def bound(stock: np.ndarray) -> int:
        return max(-(-int(stock @ length) // fullest), int(stock[half:].sum()))

    least = bound(stock)
    limit, whole = 0, False
    while not whole and fewest > least:
        limit, whole = limit + 1, True
        stack = [(stock, 0, None, limit)]
        while stack:
            now, used, chain, left = stack.pop()
            if used + bound(now) >= fewest:
                continue
            budget -= 1
            if budget < 0:
                return best, False
            if not now.any():
                best, fewest = [], used
                while chain:
                    best.append(chain[:2])
                    chain = chain[2]
                best.reverse()
                continue
            rank = 0
            for filling in _fillings(now, int(np.flatnonzero(now)[-1]), capacity):
                if rank > left:
                    whole = False
                    break
                budget -= 1
                if budget < 0:
                    return best, False
                if filling is None:
                    continue
                if used + 1 + bound(_without(now, filling, 1)) >= fewest:
                    if used + 1 + -(-int(now @ length - sum(x * n for x, n in filling.items())) // fullest) >= fewest:
                        break  # fillings of more waste are no better
                    continue
                most = min(int(now[x]) // n for x, n in filling.items())
                for late, times in enumerate(_times(most)):
                    if rank + late > left:
                        whole = False
                        break
                    stack.append((_without(now, filling, times), used + times, (filling, times, chain), left - rank - late))
                rank += 1
    return best, True


def _best_fit(stock: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram; open sequences with equal contents move as one."""
    open_bins: list[tuple[int, dict[int, int], int]] = []
    for x in range(capacity, 0, -1):
        left = int(stock[x])
        open_bins.sort(key=lambda o: o[0])
        fresh = []
        for space, pattern, times in open_bins:
            fits = space // x
            used = min(times, left // fits) if fits else 0
            if used:
                fresh.append((space - fits * x, pattern | {x: fits}, used))
                left -= used * fits
            if used < times:
                if fits and 0 < left < fits:
                    fresh.append((space - left * x, pattern | {x: left}, 1))
                    left, used = 0, used + 1
                if used < times:
                    fresh.append((space, pattern, times - used))
        fits = capacity // x
        if left // fits:
            fresh.append((capacity - fits * x, {x: fits}, left // fits))
        if left % fits:
            fresh.append((capacity - left % fits * x, {x: left % fits}, 1))
        open_bins = fresh
    return [(pattern, times) for _, pattern, times in open_bins]


def plan(stock: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Fillings (length -> how many) and how often each is used; ``stock[x]`` pieces have length x."""
    both = [_completion(stock, capacity), _best_fit(stock, capacity)]
    return branch_and_bound(stock, capacity, min(both, key=lambda p: sum(times for _, times in p)))[0]


def _placed(patterns: list[Pattern], capacity: int):
    """Ranges of ranks of each length, with the sequences and places they get."""
    at = {x: [] for x in range(capacity + 1)}
    used, base = np.zeros(capacity + 1, np.int64), 0
    for pattern, times in patterns:
        place = 0
        for x in sorted(pattern, reverse=True):
            n = pattern[x]
            at[x].append((int(used[x]), n, base, place))
            used[x] += n * times
            place += n * x
        base += times
    tables = {x: np.array(v, np.int64).reshape(-1, 4) for x, v in at.items() if v}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own, t = np.flatnonzero(length == x), tables[int(x)]
                row = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                local = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + local // row[:, 1]
                offset[own] = row[:, 3] + local % row[:, 1] * x
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack the token ids of all documents into sequences of ``capacity`` ids.

    ``doc_id`` and ``text`` are read, other columns ignored. Null and empty
    texts are the end id alone. Documents longer than a sequence are cut from
    the end, so the first piece may be shorter; ties and repeated rows are
    packed one by one; an empty table gives an empty result. Returns one row a
    piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.when(F.col("length") == capacity, FULL_SALTS).otherwise(SALTS))
    pieces = materialize(docs.mapInArrow(_pieces(tokenizer_path, capacity), schema).withColumn("salt", salt), "pieces")

    groups = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    stock = np.zeros(capacity + 1, np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        stock[length] = n
    # at most capacity * SALTS + FULL_SALTS rows
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _placed(plan(stock, capacity), capacity), schema + ", sequence_id long, offset long"
    )
