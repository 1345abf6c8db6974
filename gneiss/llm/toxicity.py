"""Counterfactual-regularised toxicity classifier.

Logistic regression over the distinct words and word beginnings of a text (so
inflected forms count too), trained on a bounded sample of labelled documents.
They enter the model by a significance test on
the sample, so chance words of a few toxic documents stay out. Identity terms
always enter, and each labelled document that names a group is paired with a
copy of its text that names other groups instead, with all features (word
beginnings included) computed anew: the squared change of score between the two
is added to the loss for each pair, which keeps it from mattering which group
is named.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gneiss.llm import text as T

#: Labelled rows that training reads at most, those of the smallest hash.
SAMPLE_ROWS = 20_000
#: Words in the model at most, the most significant first.
MAX_WORDS = 1_024
#: A word enters with at least so many documents and so large a z score.
MIN_DOCS, MIN_Z = 3, 4.0
#: Weights of the ridge and of the counterfactual penalty.
RIDGE, COUNTERFACTUAL = 0.02, 20.0
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
#: Terms that name a group of people; each is swapped for another.
IDENTITY_TERMS = (
    "women men girls boys woman man female male gay lesbian straight bisexual transgender muslim christian jewish hindu buddhist atheist "
    "black white asian african european american mexican latino arab indian chinese immigrant immigrants refugee refugees deaf blind disabled old young"
).split()

_PLACE = {t.encode(): i for i, t in enumerate(IDENTITY_TERMS)}
#: A term as a whole word, also with s, 's or quotation marks.
_MENTION = re.compile(rb"(?i)(?<![0-9a-z\x80-\xff'])('*)(" + b"|".join(_PLACE) + rb")((?:'?s)?'*)(?![0-9a-z\x80-\xff'])")

_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (A-Z as a-z) and rows of the words (runs of letters, digits and
    apostrophes), then of their beginnings."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ink = _INK[data]
    change = np.flatnonzero(np.diff(np.concatenate(([False], ink, [False])).view(np.int8)))
    start, end = change[::2], change[1::2]
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[ink[cut] & ink[cut - 1]]  # words of two rows that touch
    start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
    sums, row = T.prefix_hash(data, T.BYTE_LOWER), np.searchsorted(offsets, start, "right") - 1
    found, rows = [T.span_hash(sums, start, end)], [row]
    for n in PREFIXES:
        longer = end - start > n
        found.append(T.mix(T.span_hash(sums, start[longer], start[longer] + n) + np.uint64(n)))
        rows.append(row[longer])
    return np.concatenate(found), np.concatenate(rows)


def _term_hashes() -> np.ndarray:
    joined = " ".join(IDENTITY_TERMS).encode()
    return _words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))[0][: len(IDENTITY_TERMS)]


def swapped(text: str | None) -> str | None:
    """The text with each term replaced by the one a number of places on, which a hash of the text gives; null without terms."""
    data = (text or "").encode()
    far = 1 + zlib.crc32(data) % (len(IDENTITY_TERMS) - 1)
    out, n = _MENTION.subn(lambda m: m[1] + IDENTITY_TERMS[(_PLACE[m[2].lower()] + far) % len(IDENTITY_TERMS)].encode() + m[3], data)
    return out.decode() if n else None


def _distinct(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, words and rows (each word once a row) of each slice of a batch."""
    data, offsets = T.utf8(batch.column("text"))
    for a, b in T.slices(offsets):
        word, row = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order = np.lexsort((word, row))
        word, row = word[order], row[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
        yield a, word[new], row[new]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for a, word, row in _distinct(batch):
            yield pa.RecordBatch.from_arrays([T.signed(word), pa.array(toxic[a + row].astype(np.int32))], ["word", "toxic"])


@dataclass
class Model:
    """Sorted word hashes with their weights, and the bias."""

    bias: float
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the model, and which of the words are in it."""
        if not len(self.words):
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return at, self.words[at] == word


def _lists(model: Model, text: pa.Array) -> list[list[int]]:
    """Positions of the model's words in each text."""
    out: list[list[int]] = [[] for _ in range(len(text))]
    for a, word, row in _distinct(pa.RecordBatch.from_arrays([text], ["text"])):
        at, known = model.look_up(word)
        at, row = at[known], row[known]
        new = np.flatnonzero(np.diff(row, prepend=-1))
        for i, own in zip(row[new], np.split(at, new[1:]), strict=False):
            out[a + int(i)] = own.tolist()
    return out


def _known(model: Model):
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            copies = [swapped(t) for t in text.to_pylist()]
            other = _lists(model, pa.array(copies, text.type))
            other = [v if t is not None else None for v, t in zip(other, copies, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_lists(model, text), kind), pa.array(other, kind), batch.column("toxic").cast(pa.int32())], ["at", "other", "toxic"])

    return run


class _Rows:
    """Positions of each row of a list column, end to end: one row never costs more than its own words."""

    def __init__(self, lists: pa.Array):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        self.ends = np.concatenate(([0], np.cumsum(count)))
        self.row = np.repeat(np.arange(len(count)), count)

    def block(self, a: int, b: int, width: int) -> np.ndarray:
        """Rows a to b as a dense block."""
        own = slice(self.ends[a], self.ends[b])
        out = np.zeros((b - a, width))
        out[self.row[own] - a, self.at[own]] = 1
        return out


#: Rows of the sample that are dense at one time while the model is fitted.
BLOCK_ROWS = 1_000


def _fit(model: Model, own: _Rows, pairs: tuple[_Rows, _Rows], y: np.ndarray) -> Model:
    """Newton steps on the ridge and counterfactual loss over the sample's rows and the pairs of texts and their copies.

    The sample stays sparse; gradients are sums over its entries, and the
    second derivatives are summed over blocks of BLOCK_ROWS rows.
    """
    n, p = len(y), len(model.words)
    swap = np.zeros((p + 1, p + 1))
    for a in range(0, len(pairs[0].ends) - 1, BLOCK_ROWS):
        b = min(a + BLOCK_ROWS, len(pairs[0].ends) - 1)
        change = pairs[0].block(a, b, p + 1) - pairs[1].block(a, b, p + 1)
        swap += change.T @ change
    w = np.zeros(p + 1)
    w[p] = model.bias
    penalty = np.full(p + 1, RIDGE)
    penalty[p] = 1e-6
    for _ in range(25):
        score = 1 / (1 + np.exp(-np.clip(w[p] + np.bincount(own.row, w[own.at], n), -30, 30)))
        off = score - y
        grad = np.append(np.bincount(own.at, off[own.row], p), off.sum()) + penalty * w + 2 * COUNTERFACTUAL * (swap @ w)
        hess = np.diag(penalty + 1e-6) + 2 * COUNTERFACTUAL * swap
        for a in range(0, n, BLOCK_ROWS):
            b = min(a + BLOCK_ROWS, n)
            x = own.block(a, b, p + 1)
            x[:, p] = 1
            x *= np.sqrt(score[a:b] * (1 - score[a:b]))[:, None]
            hess += x.T @ x
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-4:
            break
    return Model(float(w[p]), model.words, w[:p])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents whose crc32(doc_id as text) mod 5 isn't 0.

    At most :data:`SAMPLE_ROWS` of them are read, chosen by a hash of doc_id.
    A document labelled twice counts as toxic if one label says so; null
    labels and labels without a document count for nothing. Without labels the
    model is a low constant.
    """
    train_rows = (
        labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_ROWS)
    )
    # at most SAMPLE_ROWS pairs of numbers, so this side is small by construction
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(train_rows), "doc_id")
    sample = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    try:
        total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        base = (toxic + 1) / (total + 20)
        start = Model(float(np.log(base / (1 - base))))
        if not total:
            return start
        spread = sample.mapInArrow(_spread, "word long, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
        rate = float(np.clip(toxic / total, 1e-6, 1 - 1e-6))
        spread = spread.where(F.col("n") >= MIN_DOCS).withColumn("z", F.abs(F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate)))
        chosen = spread.where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(MAX_WORDS).select("word").toPandas()["word"].to_numpy(np.int64)
        terms = _term_hashes()
        model = Model(start.bias, np.union1d(chosen.view(np.uint64), terms), np.zeros(0))
        # a few numbers for each of at most SAMPLE_ROWS rows
        found = sample.mapInArrow(_known(model), "at array<int>, other array<int>, toxic int").toArrow()
        named = found.filter(found.column("other").is_valid())
        bare = _lists(model, pa.array(IDENTITY_TERMS))  # terms that no row names
        kind = pa.list_(pa.int32())
        pairs = ((named.column("at"), bare), (named.column("other"), bare[1:] + bare[:1]))
        pairs = tuple(_Rows(pa.chunked_array([*(c.cast(kind) for c in column.chunks), pa.array(rest, kind)])) for column, rest in pairs)
        return _fit(model, _Rows(found.column("at")), pairs, found.column("toxic").to_numpy().astype(float))
    finally:
        sample.unpersist()


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column("text"))
            score = np.full(batch.num_rows, model.bias)
            for a, b in T.slices(offsets):
                word, row = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at, known = model.look_up(word)
                if known.any():
                    pair = np.unique(row[known] * len(model.words) + at[known])
                    score[a:b] += np.bincount(pair // len(model.words), model.weights[pair % len(model.words)], b - a)
            score = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], [*batch.schema.names, "toxicity_score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``toxicity_score`` (0 to 1) of the whole text.

    Null and empty texts get the score of a text without known words. Every
    input row gives one row, repeated rows included. A column that already has
    the new column's name is replaced.
    """
    docs = docs.drop("toxicity_score")
    schema = StructType([*docs.schema.fields, StructField("toxicity_score", DoubleType())])
    return docs.mapInArrow(_scores(model), schema)
