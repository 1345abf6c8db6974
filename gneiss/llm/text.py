"""Vectorised text kernels that run inside tasks on Arrow string columns.

All hashes are 64 bits wide and depend on bytes alone, so any task on any
machine gives the same value for the same text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as every batch needs it."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        table = np.full(max(n, 1 << 20), U(base))
        table[0] = 1
        _powers[base] = kept = np.cumprod(table, dtype=np.uint64)
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser; every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; one longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def prefix_hash(data: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """Running polynomial sums; see :func:`span_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end): equal bytes give equal hashes."""
    inverse = _power(_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] ^ mix((end - start).astype(np.uint64)))


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """:func:`span_hash` of the n bytes from each place that has as many."""
    sums = prefix_hash(data)
    size = mix(np.array([n], np.uint64))
    return mix((sums[n:] - sums[:-n]) * _power(_INVERSE, len(sums))[: len(sums) - n] ^ size)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word, a run of bytes that aren't white space."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    ink = ~_SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(ink[:-1], out=first[1:])
    inner = offsets[1:-1]
    first[inner[inner < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(ink[1:], out=last[:-1])
    last[inner[inner > 0] - 1] = True
    start = np.flatnonzero(ink & first)
    end = np.flatnonzero(ink & last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (A-Z as a-z) and row of each word."""
    start, end, row = words(data, offsets)
    return span_hash(prefix_hash(data, BYTE_LOWER), start, end), row


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row as sorted hashes, with row offsets.

    A row of fewer than k words has its whole sequence as one shingle; a row
    without words has none.
    """
    n = len(offsets) - 1
    word, row = word_hashes(data, offsets)
    count = np.bincount(row, minlength=n)
    at = np.concatenate(([0], np.cumsum(count)))
    if len(word) >= k:
        run = word[: len(word) - k + 1].copy()
        for j in range(1, k):
            run = mix(run * U(0x2545F4914F6CDD1D) + word[j : len(word) - k + 1 + j])
        whole = row[: len(row) - k + 1] == row[k - 1 :]
        long_hash, long_row = run[whole], row[: len(row) - k + 1][whole]
    else:
        long_hash, long_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    short_hash = mix(count[short].astype(np.uint64) + U(977))
    for j in range(k - 1):
        more = count[short] > j
        picked = word[np.minimum(at[short] + j, max(len(word) - 1, 0))] if len(word) else short_hash
        short_hash = np.where(more, mix(short_hash * U(0x2545F4914F6CDD1D) + picked), short_hash)
    rows = np.concatenate((long_row, short))
    order = np.argsort(rows, kind="stable")
    hashes, rows = np.concatenate((long_hash, short_hash))[order], rows[order]
    to = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    for a, b in zip(to[:-1], to[1:], strict=True):
        hashes[a:b].sort()
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[new], rows[new]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))


def set_hash(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each row's set; rows with equal sets are equal."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ U(0xA0761D6478BD642F)), out=sums[1:])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ mix(np.diff(offsets).astype(np.uint64)))


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark longs."""
    return pa.array(x.view(np.int64), pa.int64())
