"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark and kept as chunks: a chunk's distinct
words, and for each document the positions of its words in them. The chunks'
words are dealt by hash over shards, where each distinct word is encoded once
and its ids are decoded by a join of ids with the vocabulary's pieces. Ids and
pieces go back to the chunks, where each word's position takes them up.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as T
from gneiss.sources.storage import materialize

#: Bytes of text in a chunk (a longer text stands alone), and bytes of text for each shard of words.
CHUNK_BYTES = 14 << 20
SHARD_BYTES = 32 << 20
#: The special tokens and the word pattern of this vocabulary.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = regex.compile("(" + "|".join(map(regex.escape, SPECIAL)) + ")")
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters from here on may be of a class that the two libraries know differently: such texts are split by the file's own rules.
_FAR = re.compile("[^\x00-\u052f]")


@cache
def _own_split(path: str) -> Callable[[str], list[str]]:
    """The file's own normaliser and word pattern, without its byte letters."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    normalizer = Tokenizer.from_file(path).normalizer
    with open(path, encoding="utf-8") as f:
        spec = next(p for p in json.load(f)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    pattern = pre_tokenizers.Split(Regex(spec["pattern"]["Regex"]), spec["behavior"].lower(), spec["invert"])
    return lambda text: [word for word, _ in pattern.pre_tokenize_str(normalizer.normalize_str(text))]


def split(text: str, path: str) -> list[str]:
    """Words in order: special tokens as they stand, the rest normalised and split as the tokenizer file says."""
    plain = _own_split(path) if _FAR.search(text) else _plain
    if "<|" not in text:
        return plain(text)
    parts = _SPECIAL.split(text)
    return list(chain.from_iterable([part] if i % 2 else plain(part) for i, part in enumerate(parts)))


def _plain(text: str) -> list[str]:
    """The same for letters whose class is long settled, by the faster library."""
    if not text.isascii():
        # letter by letter, so a final sigma stays an ordinary one
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return _WORD.findall(text.lower())


@cache
def _tokenizer(path: str):
    """The file's tokenizer for single words, and its pieces by id."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    pieces = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    tokenizer.normalizer = normalizers.Sequence([])
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer, pa.array(pieces, pa.string())


def _squeeze(numbers: np.ndarray, level: int = 3) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def _stretch(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _chunk(ids: pa.Array, texts: pa.Array, shards: int, path: str) -> pa.RecordBatch:
    known: dict[str, int] = {}
    at, count = [], []
    for text in texts:
        words = split(text.as_py() or "", path)
        for w in words:
            if w not in known:
                known[w] = len(known)
        at.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
        count.append(len(words))
    at = np.concatenate(at) if at else np.zeros(0, np.uint32)
    frequent = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
    place = np.empty(len(known), np.uint32)
    place[frequent] = np.arange(len(known), dtype=np.uint32)
    words = list(known)
    shard = np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in words), np.int64, len(words))
    order = np.array(sorted(range(len(words)), key=lambda i: (shard[i], words[i])), np.int64)
    used, start = np.unique(shard[order], return_index=True)
    ends = np.append(start[1:], len(order))[: len(used)]
    packer = zstandard.ZstdCompressor(level=3)
    asked = [
        {"shard": int(s), "words": packer.compress("\n".join([words[i] for i in order[x:y]]).encode())}
        for s, x, y in zip(used, start, ends, strict=True)
    ]
    # at which of its chunk's answers each word (frequent first) is
    answer = np.empty(len(words), np.uint32)
    answer[place[order]] = np.arange(len(words), dtype=np.uint32)
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([count], pa.list_(pa.int32())),
            pa.array([_squeeze(place[at], 9)], pa.binary()),
            pa.array([_squeeze(answer)], pa.binary()),
            pa.array([asked], pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary())]))),
        ],
        ["doc_ids", "counts", "positions", "answer", "asked"],
    )


def _chunks(shards: int, path: str):
    """Chunks of documents: distinct words by shard, and each position's word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = T.utf8(batch.column("text"))
            for a, b in T.slices(offsets, CHUNK_BYTES):
                yield _chunk(batch.column("doc_id")[a:b], batch.column("text")[a:b], shards, path)

    return run


def _encoded(path: str):
    """Each distinct word of a shard encoded once; ids and how many for each chunk's words."""

    def run(table: pa.Table) -> pa.Table:
        tokenizer, _ = _tokenizer(path)
        asked = [zstandard.ZstdDecompressor().decompress(x.as_buffer()).decode().split("\n") for x in table.column("words")]
        known = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(asked)))}
        words, ids = list(known), []
        for at in range(0, len(words), 20_000):
            ids += [e.ids for e in tokenizer.encode_batch(words[at : at + 20_000], add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))
        start = np.concatenate(([0], np.cumsum(count)))[:-1]
        counts, spans = [], []
        for own in asked:
            at = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
            counts.append(_squeeze(count[at]))
            spans.append(_squeeze(flat[_ranges(start[at], count[at])]))
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "counts": pa.array(counts, pa.binary()), "ids": pa.array(spans, pa.binary())})

    return run


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count numbers) of each entry, end to end."""
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(count) else np.zeros(0, np.int64)
    return shift + np.arange(int(count.sum()))


def _documents(path: str, digests: bool):
    """Ids and decoded text of each document of a chunk, or their digests."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        _, pieces = _tokenizer(path)
        by_shard = np.argsort(answers.column("shard").to_numpy()).tolist()
        count = [_stretch(answers.column("counts")[i].as_buffer()) for i in by_shard]
        flat = [_stretch(answers.column("ids")[i].as_buffer()) for i in by_shard]
        none = np.zeros(0, np.uint32)
        count, flat = np.concatenate(count or [none]).astype(np.int64), np.concatenate(flat or [none])
        start = np.concatenate(([0], np.cumsum(count)))[:-1]
        # decoding joins ids with pieces; pieces of a text are joined by blanks
        spelled = pieces.take(pa.array(flat)).to_pylist()
        decoded = [" ".join(spelled[s : s + n]) for s, n in zip(start.tolist(), count.tolist(), strict=True)]
        del spelled
        doc_ids, n_tokens, ids, texts = [], [], [], []
        for row in range(chunk.num_rows):
            at = _stretch(chunk.column("answer")[row].as_buffer())[_stretch(chunk.column("positions")[row].as_buffer())]
            ends = np.cumsum(chunk.column("counts")[row].values.to_numpy()).tolist()
            doc_ids += chunk.column("doc_ids")[row].as_py()
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                own = at[a:b]
                n_tokens.append(int(count[own].sum()))
                encoded, text = flat[_ranges(start[own], count[own])].astype("<u4").tobytes(), " ".join(map(decoded.__getitem__, own.tolist()))
                ids.append(hashlib.sha256(encoded).hexdigest() if digests else encoded)
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
        kind = pa.string() if digests else pa.binary()
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(ids, kind), pa.array(texts, pa.string())], names=_NAMES[digests])

    return run


_NAMES = {False: ["doc_id", "n_tokens", "ids", "decoded"], True: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]}


def encode_decode(docs: DataFrame, tokenizer_path: str, digests: bool = False) -> DataFrame:
    """Token ids of each whole text and the text decoded from them.

    Returns ``doc_id``, ``n_tokens``, ``ids`` (little-endian 32-bit) and
    ``decoded``; with ``digests`` their SHA-256 as ``ids_sha256`` and
    ``decoded_sha256`` instead, formed where the values are. Null and empty
    texts have no tokens; each input row gives one row, repeated rows and null
    doc_ids included. Other columns are ignored. A text of any length is one
    chunk's row; a word of any length is one word.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, int(size) // SHARD_BYTES)
    schema = "doc_ids array<long>, counts array<int>, positions binary, answer binary, asked array<struct<shard: int, words: binary>>"
    chunks = materialize(docs.mapInArrow(_chunks(shards, tokenizer_path), schema).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    asked = chunks.select("chunk", F.explode("asked").alias("asked")).select("chunk", "asked.*")
    answers = asked.groupBy("shard").applyInArrow(_encoded(tokenizer_path), "chunk long, shard int, counts binary, ids binary")
    kind = "string" if digests else "binary"
    a, b, c, d = _NAMES[digests]
    result = f"{a} long, {b} long, {c} {kind}, {d} string"
    return chunks.drop("asked").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_documents(tokenizer_path, digests), result)
