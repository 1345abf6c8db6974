"""Cross-tokenizer alignment through a table of distinct segments.

A text, with a blank before it, is cut before runs of blanks, where neither
vocabulary has a piece that goes on from ink into a blank (:func:`separable`
looks at every piece), so both tokenizers work on each segment alone. Texts
are kept as chunks: a chunk's distinct segments, and each document's segments
as places among them. Chunks ask shards of the hash range; a shard tokenises
and aligns each distinct segment once and answers with its links: overlapping
tokens of A and B in order of bytes, and which of them end there. Chunks
compose documents from the answers, say how many of their documents hold each
linked id pair, and take the corpus-wide counts of their pairs from a join.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as T
from gneiss.llm.word_bpe import _ranges, _squeeze, _stretch
from gneiss.sources.storage import materialize

#: Bytes of text in a chunk (a longer text stands alone), and distinct segments of a shard.
CHUNK_BYTES = 16 << 20
SHARD_SEGMENTS = 400_000
#: Least hashes of a chunk that go into the estimate of the number of distinct segments.
LEAST = 256
#: Links composed at a time within a task.
BLOCK = 1_000_000
#: Ink, but not the letter that B writes for a blank, then blanks that something follows; what isn't ink, before a blank.
_ODD = re.compile("[\\s▁] ")
_CUT = re.compile("(?<=[^\\s▁])(?= +[^ ])")
#: In a piece: ink before a blank.
_CROSSES = re.compile("[^\\s▁][ ▁]")

A_ENDS, B_ENDS = 1, 2


class _Vocabulary:
    """The bytes of each id's piece, end to end."""

    def __init__(self, pieces: list[bytes]):
        self.length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_ranges(self.start[ids], self.length[ids])]


@cache
def _byte_level(path: str):
    """Tokenizer A and its vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # fixed value: the letters that stand for bytes in byte-level vocabularies
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    with open(path, encoding="utf-8") as f:
        special = {t["content"] for t in json.load(f)["added_tokens"]}
    pieces = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return tokenizer, _Vocabulary([p.encode() if p in special else bytes(letter[c] for c in p) for p in pieces])


@cache
def _pieces(path: str):
    """Tokenizer B and its vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return model, _Vocabulary([bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids])


def separable(path_a: str, path_b: str) -> bool:
    """Whether no piece of either vocabulary goes on from ink into a blank."""
    crossing = False
    for vocabulary in (_byte_level(path_a)[1], _pieces(path_b)[1]):
        whole = vocabulary.data.tobytes()
        spelled = (whole[s : s + n].decode(errors="replace") for s, n in zip(vocabulary.start.tolist(), vocabulary.length.tolist(), strict=True))
        crossing |= any(_CROSSES.search(piece) for piece in spelled)
    return not crossing


def segments(text: str, cut: bool) -> list[str]:
    """The text with a blank before it, in pieces that begin with a blank, each without that blank."""
    if not text or not cut:
        return [text] if text else []
    if text[0] != " " and text[-1] != " " and not _ODD.search(text):
        return text.split(" ")
    return [piece[1:] for piece in _CUT.split(" " + text)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.int64, int(count.sum())), count


def _sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of each run of ``count`` values."""
    upto = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(count)
    return upto[ends] - upto[ends - count]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values by one sort, which beats numpy's hash table here."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def align(texts: list[str], path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of each segment (without its blank): how many (-1 where joined bytes differ from the segment's), and, end to end, ids of A, ids of B and what ends."""
    tokenizer, known_a = _byte_level(path_a)
    model, known_b = _pieces(path_b)
    ids, count = [], []
    for lists in ([e.ids for e in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)], model.encode(texts, num_threads=1)):
        flat, n = _flat(lists)
        ids.append(flat)
        count.append(n)
    raw = [b" " + t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    good = np.ones(len(texts), bool)
    for flat, n, known in zip(ids, count, (known_a, known_b), strict=True):
        good &= _sums(known.length[flat], n) == size
    for i, known in enumerate((known_a, known_b)):
        own = ids[i][np.repeat(good, count[i])]
        text = np.frombuffer(b"".join(r for r, g in zip(raw, good, strict=True) if g), np.uint8)
        wrong = np.flatnonzero(known.spell(own) != text)
        if len(wrong):
            good[np.flatnonzero(good)[np.searchsorted(np.cumsum(size[good]), wrong, "right")]] = False
    own_a, own_b = (flat[np.repeat(good, n)] for flat, n in zip(ids, count, strict=True))
    end_a, end_b = np.cumsum(known_a.length[own_a]), np.cumsum(known_b.length[own_b])
    ends = _distinct(np.concatenate((end_a, end_b)))
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    what = (end_a[at_a] == ends) * A_ENDS + (end_b[at_b] == ends) * B_ENDS
    links = np.full(len(texts), -1, np.int64)
    links[good] = np.diff(np.concatenate(([0], np.searchsorted(ends, np.cumsum(size[good]), "right"))))
    return links, own_a[at_a].astype(np.uint32), own_b[at_b].astype(np.uint32), what.astype(np.uint8)


def _pack(texts: list[str]) -> tuple[bytes, bytes]:
    raw = [t.encode() for t in texts]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(raw)), _squeeze(np.fromiter(map(len, raw), np.uint32, len(raw)))


def _unpack(data: pa.Scalar, lengths: pa.Scalar) -> list[str]:
    whole = zstandard.ZstdDecompressor().decompress(data.as_buffer())
    ends = [0, *np.cumsum(_stretch(lengths.as_buffer())).tolist()]
    return [whole[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _hashes(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))


def _chunks(cut: bool):
    """Chunks of documents: distinct segments in order of their hashes, and each document's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = T.utf8(batch.column("text"))
            for a, b in T.slices(offsets, CHUNK_BYTES):
                known = defaultdict(itertools.count().__next__)
                at, count = [], []
                for text in batch.column("text")[a:b]:
                    own = segments(text.as_py() or "", cut)
                    at.append(np.fromiter(map(known.__getitem__, own), np.uint32, len(own)))
                    count.append(len(own))
                names = list(known)
                hashes = _hashes(names)
                order = np.argsort(hashes, kind="stable")
                place = np.empty(len(names), np.uint32)
                place[order] = np.arange(len(names), dtype=np.uint32)
                data, lengths = _pack([names[i] for i in order.tolist()])
                least = (hashes[order[:LEAST]] >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("doc_id")[a:b]),
                        pa.array([count], pa.list_(pa.int32())),
                        pa.array([_squeeze(place[np.concatenate(at)])], pa.binary()),
                        pa.array([data], pa.binary()),
                        pa.array([lengths], pa.binary()),
                        pa.array([least], pa.list_(pa.int64())),
                    ],
                    ["doc_ids", "counts", "places", "segments", "lengths", "least"],
                )

    return run


_CHUNK = "doc_ids array<long>, counts array<int>, places binary, segments binary, lengths binary, least array<long>"


def _asked(shards: int):
    """A chunk's segments by shard, each a range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk")):
                names = _unpack(batch.column("segments")[i], batch.column("lengths")[i])
                shard = ((_hashes(names) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                used, start = np.unique(shard, return_index=True)
                packed = [_pack(names[a:b]) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(names)], strict=True)] if len(names) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.as_py()] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())],
                    ["chunk", "shard", "segments", "lengths"],
                )

    return run


def _longer(old: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``old`` with ``new`` from place ``used`` on; room doubles, so adding is cheap."""
    if used + len(new) > len(old):
        room = np.empty(max(2 * len(old), used + len(new)), old.dtype)
        room[:used] = old[:used]
        old = room
    old[used : used + len(new)] = new
    return old


def _answers(path_a: str, path_b: str):
    """Each distinct segment of a shard aligned once; packets stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        links, a, b, what = np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint8)
        start, used = np.empty(0, np.int64), 0
        for batch in batches:
            for i, chunk in enumerate(batch.column("chunk")):
                own = _unpack(batch.column("segments")[i], batch.column("lengths")[i])
                fresh = [s for s in own if s not in known]
                for x in range(0, len(fresh), 20_000):
                    part = fresh[x : x + 20_000]
                    n, ids_a, ids_b, ends = align(part, path_a, path_b)
                    first = len(known)
                    start = _longer(start, first, used + np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0))
                    links = _longer(links, first, n)
                    a, b, what = _longer(a, used, ids_a), _longer(b, used, ids_b), _longer(what, used, ends)
                    used += len(ids_a)
                    known.update(zip(part, range(first, first + len(part)), strict=True))
                at = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                n = links[at]
                span = _ranges(start[at], np.maximum(n, 0))
                packer = zstandard.ZstdCompressor(level=3)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk.as_py()], pa.int64()),
                        pa.array([batch.column("shard")[i].as_py()], pa.int32()),
                        pa.array([_squeeze(n + 1)], pa.binary()),
                        pa.array([_squeeze(a[span])], pa.binary()),
                        pa.array([_squeeze(b[span])], pa.binary()),
                        pa.array([packer.compress(what[span].tobytes())], pa.binary()),
                    ],
                    ["chunk", "shard", "n", "a", "b", "what"],
                )

    return run


@cache
def _numbers(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each number below ``most`` in decimal before a comma, a bar and a semicolon: bytes, starts and lengths at three times the number and on."""
    spelled = [f"{i}{sign}".encode() for i in range(most) for sign in ",|;"]
    length = np.fromiter(map(len, spelled), np.int64, len(spelled))
    return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate(([0], np.cumsum(length)))[:-1], length


def _spelled(links: np.ndarray, a: np.ndarray, b: np.ndarray, what: np.ndarray, block: int) -> list[bytes]:
    """Groups of each segment, every one with a semicolon after it."""
    data, starts, lengths = _numbers(1 << int(max(a.max(initial=0), b.max(initial=0), 1)).bit_length())
    out, upto = [], np.concatenate(([0], np.cumsum(links)))
    at = 0
    while at < len(links):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + block, "right")) - 1)
        x, y = upto[at], upto[to]
        ends = what[x:y]
        both = ends == A_ENDS | B_ENDS
        group = np.cumsum(both) - both
        in_a, in_b = np.flatnonzero(ends & A_ENDS), np.flatnonzero(ends & B_ENDS)
        groups = int(both.sum())
        n_a, n_b = np.bincount(group[in_a], minlength=groups), np.bincount(group[in_b], minlength=groups)
        word = np.empty(len(in_a) + len(in_b), np.int64)
        # A's tokens of a group come before B's
        word[np.arange(len(in_a)) + (np.cumsum(n_b) - n_b)[group[in_a]]] = a[x:y][in_a].astype(np.int64) * 3 + both[in_a]
        word[np.arange(len(in_b)) + np.cumsum(n_a)[group[in_b]]] = b[x:y][in_b].astype(np.int64) * 3 + 2 * both[in_b]
        text = data[_ranges(starts[word], lengths[word])].tobytes()
        tokens = _sums((ends & A_ENDS > 0).astype(np.int64) + (ends & B_ENDS > 0), links[at:to])
        cut = [0, *np.cumsum(_sums(lengths[word], tokens)).tolist()]
        out += [text[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        at = to
    return out


def _composed(digests: bool):
    """Documents of a chunk from its segments' links, and how many of them hold each id pair."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        parts = {name: [] for name in ("n", "a", "b", "what")}
        for i in np.argsort(answers.column("shard").to_numpy()).tolist():
            for name in ("n", "a", "b"):
                parts[name].append(_stretch(answers.column(name)[i].as_buffer()))
            parts["what"].append(np.frombuffer(zstandard.ZstdDecompressor().decompress(answers.column("what")[i].as_buffer()), np.uint8))
        n, a, b, what = (np.concatenate(parts[name] or [np.zeros(0, kind)]) for name, kind in (("n", np.uint32), ("a", np.uint32), ("b", np.uint32), ("what", np.uint8)))
        links = n.astype(np.int64) - 1
        bad, links = links < 0, np.maximum(links, 0)
        counts = chunk.column("counts")[0].values.to_numpy().astype(np.int64)
        places = _stretch(chunk.column("places")[0].as_buffer()).astype(np.int64)
        # a document with a segment that differs has no tokens
        whole = _sums(bad[places].astype(np.int64), counts) == 0
        places, counts = places[np.repeat(whole, counts)], np.where(whole, counts, 0)
        pairs, local = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)

        figures = {"n_a": what & A_ENDS > 0, "n_b": what & B_ENDS > 0, "n_groups": what == A_ENDS | B_ENDS, "n_links": np.ones(len(what), bool)}
        figures = {k: _sums(_sums(v.astype(np.int64), links)[places], counts) for k, v in figures.items()}
        spelled = _spelled(links, a, b, what, BLOCK // 4)
        ends = [0, *np.cumsum(counts).tolist()]
        groups = []
        for x, y in zip(ends[:-1], ends[1:], strict=True):
            own = b"".join(map(spelled.__getitem__, places[x:y].tolist()))[:-1]
            groups.append((hashlib.sha256(own).hexdigest() if own else "") if digests else own.decode())
        del spelled

        start, held = np.cumsum(links) - links, np.zeros(len(pairs), np.int64)
        size, row = _sums(links[places], counts), 0
        upto = np.concatenate(([0], np.cumsum(size)))
        while row < len(counts):
            to = max(row + 1, int(np.searchsorted(upto, upto[row] + BLOCK, "right")) - 1)
            x, y = ends[row], ends[to]
            doc = np.repeat(np.arange(to - row), counts[row:to])
            doc, own = np.divmod(_distinct(doc * len(links) + places[x:y]), max(len(links), 1))
            key = np.repeat(doc, links[own]) * len(pairs) + local[_ranges(start[own], links[own])]
            held += np.bincount(_distinct(key) % max(len(pairs), 1), minlength=len(pairs))
            row = to
        used = held > 0
        rename = np.cumsum(used) - 1
        kept = np.repeat(~bad, links) & used[local]
        row = {
            "chunk": [chunk.column("chunk")[0].as_py()], "doc_ids": [chunk.column("doc_ids")[0].as_py()], "counts": [counts], **{k: [v] for k, v in figures.items()}, "groups": [groups],
            "places": [_squeeze(places)], "links": [_squeeze(_sums(kept.astype(np.int64), links))], "local": [_squeeze(rename[local[kept]])], "pairs": [pairs[used]], "held": [held[used]],
        }
        return pa.table({k: pa.array(v, pa.binary() if isinstance(v[0], bytes) else pa.list_(pa.string()) if k == "groups" else pa.int64() if k == "chunk" else pa.list_(pa.int64())) for k, v in row.items()})

    return run


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
_COMPOSED = f"chunk long, doc_ids array<long>, counts array<long>, {', '.join(f'{k} array<long>' for k in _FIGURES)}, groups array<string>, places binary, links binary, local binary, pairs array<long>, held array<long>"


def _counted(name: str):
    """Documents with the sums of their links' counts."""

    def run(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs.column("pair").to_numpy())
        n, best = (pairs.column(k).to_numpy()[order].astype(np.int64) for k in ("n", "best"))
        counts = chunk.column("counts")[0].values.to_numpy()
        places, links, local = (_stretch(chunk.column(k)[0].as_buffer()).astype(np.int64) for k in ("places", "links", "local"))
        sums = {"n_best": best, "count_sum": n}
        sums = {k: _sums(_sums(v[local], links)[places], counts) for k, v in sums.items()}
        out = {"doc_id": chunk.column("doc_ids")[0].values, **{k: chunk.column(k)[0].values for k in _FIGURES}, **sums, name: chunk.column("groups")[0].values}
        return pa.table(out)

    return run


def _documents(docs: DataFrame, path_a: str, path_b: str, digests: bool) -> DataFrame:
    """One row a chunk: its documents' figures, and the linked id pairs that they hold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = docs.mapInArrow(_chunks(separable(path_a, path_b)), _CHUNK).withColumn("chunk", F.monotonically_increasing_id())
    chunks = materialize(chunks, "segments")
    # the k least hashes of all distinct segments say how many there are
    least = [r["h"] for r in chunks.select(F.explode("least").alias("h")).distinct().orderBy("h").limit(LEAST).collect()]
    distinct = len(least) if len(least) < LEAST else LEAST * 2**63 // (least[-1] + 1)
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct // SHARD_SEGMENTS))
    asked = chunks.select("chunk", "segments", "lengths").mapInArrow(_asked(shards), "chunk long, shard int, segments binary, lengths binary")
    answers = asked.groupBy("shard").applyInArrow(_answers(path_a, path_b), "chunk long, shard int, n binary, a binary, b binary, what binary")
    own = chunks.select("chunk", "doc_ids", "counts", "places").groupBy("chunk")
    return materialize(own.cogroup(answers.groupBy("chunk")).applyInArrow(_composed(digests), _COMPOSED), "aligned")


def _pair_counts(composed: DataFrame) -> DataFrame:
    held = composed.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").alias("n"))
    return held.groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a``, ``b`` and ``n_docs``, the number of documents that hold the id pair linked."""
    counts = _pair_counts(_documents(docs, path_a, path_b, digests=True))
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("b"), F.col("n").alias("n_docs"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, digests: bool = False) -> DataFrame:
    """Tokens of a byte-level BPE (A, over the text with a blank before it) and of a piece BPE (B) aligned by bytes.

    Returns for each document ``doc_id``, ``n_a``, ``n_b``, ``n_groups``
    (between places where tokens of both end), ``n_links`` (overlapping
    tokens), ``n_best`` (links whose id pair is in as many documents as the
    most frequent one of its A id), ``count_sum`` (documents that hold the
    pair, over links) and ``groups``, such as ``a1,a2|b1;a3|b2``; with
    ``digests`` its SHA-256 as ``groups_sha256``, or '' without tokens. Null
    and empty texts, and those whose joined bytes in A or B differ from the
    text's, have zeros and ''. Each input row is a document and gives a row,
    repeated rows and null doc_ids included. Other columns are ignored. A text
    without blanks is one segment, whatever its length. An empty table gives
    an empty result.
    """
    composed = _documents(docs, path_a, path_b, digests)
    counts = materialize(_pair_counts(composed).withColumn("a", F.shiftright("pair", 32)), "pair_counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    table = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    own = composed.select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair")).join(table, "pair")
    name = "groups_sha256" if digests else "groups"
    result = f"doc_id long, {', '.join(f'{k} long' for k in _FIGURES)}, n_best long, count_sum long, {name} string"
    return composed.drop("pairs", "held").groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(_counted(name), result)
