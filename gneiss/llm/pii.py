"""Personal data: exact patterns, and a skip-chain conditional random field.

Patterns give the base spans of four kinds. The field labels candidate tokens:
words with a digit or an @, and groups of digits that blanks, dashes, dots or
brackets hold together. A token's shape gives its node potential, tokens side
by side share a chain potential, and tokens of one document that are written
alike (equal text, or equal first or last seven digits) share a skip potential
however far apart they are: each is linked to the first of its kind. Labels of
base spans are known; loopy belief propagation passes messages over both kinds
of edges at once, for all documents of a batch together, until they settle.
Tokens that the field is sure of and no base span covers become further spans:
a number written without its prefix where the same document also has it in
full.

Node, chain and skip weights are fitted together by pseudo-likelihood on a
bounded sample of documents, whose base spans are the labels. A token without
a base span that is written like one with a base span is no example of either
label, so it is left out. Only counts of configurations leave the tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents that training reads at most, those of the smallest hash.
SAMPLE_DOCS = 4_000
#: Belief from which a token becomes a span.
SURE = 0.9
#: Messages have settled when none moves by more than this, and rounds after which they are taken as they are.
SETTLED, ROUNDS = 1e-4, 200
#: Digits that make two numbers alike, and letters that a token of equal text has at least.
ALIKE_DIGITS, ALIKE_TEXT = 7, 5
#: Skip potential of equal labels before any example is seen.
AGREE = 4.0
#: Digits of a candidate at most, and equal labels among a token's skip neighbours that the fit tells apart.
MOST_DIGITS, MOST_NEIGHBOURS = 19, 3

# fixed values: the base patterns (local parts are found from the @ leftwards)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9@._%+()\-])[A-Za-z._%+()\-]*+[0-9@][A-Za-z0-9@._%+()\-]*+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LETTER = re.compile(r"[A-Za-z@_%]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of every base match, by start and then kind."""
    if not _HINT.search(text):
        return []
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, 0, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Bits of a shape: see :func:`_shape`.
_BITS = 14


def _shape(token: str, digits: str) -> int:
    n = len(digits)
    marks = (
        "@" in token, token.startswith("+"), "(" in token, "-" in token[1:], token.count(".") == 3, "." in token, n < 3, 3 <= n < 7, 7 <= n < 9, 9 <= n < 12,
        12 <= n < 20, n >= 20, 12 <= n < 20 and luhn(digits), sum(map(str.isalpha, token)) > 0,
    )
    return sum(1 << i for i, m in enumerate(marks) if m)


@dataclass
class Graph:
    """Tokens of some texts as (text, start, end), their shapes, labels (0: none), chain and skip edges."""

    tokens: list[Span]
    shapes: np.ndarray
    labels: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _candidates(text: str) -> Iterator[Span]:
    """(start, digits, end) of each candidate: a token, or tokens of digits with single blanks between."""
    held = None
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while b > a + 1 and text[b - 1] in ".-(":
            b -= 1
        digits = _NOT_DIGIT.sub("", text[a:b])
        bare = not _LETTER.search(text, a, b)
        if held and bare and held[3] and a - held[2] == 1 and text[a - 1] == " " and len(held[1]) + len(digits) <= MOST_DIGITS:
            held = (held[0], held[1] + digits, b, True)
            continue
        if held:
            yield held[:3]
        held = (a, digits, b, bare)
    if held:
        yield held[:3]


def _alike(token: str, digits: str) -> list[str]:
    """Keys that tokens written alike have in common."""
    if len(digits) >= ALIKE_DIGITS:
        return ["<" + digits[:ALIKE_DIGITS], ">" + digits[-ALIKE_DIGITS:]]
    return ["=" + token.lower()] if len(token) >= ALIKE_TEXT else []


def graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    tokens, shapes, labels, chain, skip = [], [], [], [], []
    for i, text in enumerate(texts):
        if not _HINT.search(text):
            continue
        last, first, own, s = None, {}, spans[i], 0
        for a, digits, b in _candidates(text):
            while s < len(own) and own[s][2] <= a:
                s += 1
            at = len(tokens)
            tokens.append((i, a, b))
            shapes.append(_shape(text[a:b], digits))
            labels.append(next((k + 1 for x, k, y in own[s : s + 4] if x < b and a < y), 0))
            if last is not None and a - tokens[last][2] <= 1:
                chain.append((last, at))
            last = at
            linked = {first.setdefault(key, at) for key in _alike(text[a:b], digits)} - {at}
            skip += [(hub, at) for hub in sorted(linked)]
    edges = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
    return Graph(tokens, np.array(shapes, np.int64), np.array(labels, np.int64), *edges)


_LABELS = len(KINDS) + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Configurations of labelled tokens: shape, labels of the left and right one (-1: none), of skip neighbours, and own."""
    seen: Counter = Counter()
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        g = graph(texts, [base_spans(t) for t in texts])
        y = g.labels
        ends = np.concatenate((g.skip, g.skip[:, ::-1]))
        hidden = np.zeros(len(y), bool)
        hidden[ends[(y[ends[:, 0]] == 0) & (y[ends[:, 1]] > 0), 0]] = True
        shown = np.where(hidden, -1, y)
        left, right = np.full(len(y), -1), np.full(len(y), -1)
        left[g.chain[:, 1]], right[g.chain[:, 0]] = shown[g.chain[:, 0]], shown[g.chain[:, 1]]
        known = ends[shown[ends[:, 1]] >= 0]
        near = np.zeros((len(y), _LABELS), np.int64)
        np.add.at(near, (known[:, 0], y[known[:, 1]]), 1)
        near = np.minimum(near, MOST_NEIGHBOURS)
        rows = np.column_stack((g.shapes, left, right, near, y))[~hidden]
        seen.update(map(tuple, rows.tolist()))
    yield pa.RecordBatch.from_pydict({"what": [list(k) for k in seen], "n": list(seen.values())}, pa.schema([("what", pa.list_(pa.int64())), ("n", pa.int64())]))


@dataclass
class Field:
    """Weights of shape bits by label, and log potentials of the two kinds of edges."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _bits(shapes: np.ndarray) -> np.ndarray:
    return np.concatenate(((shapes[:, None] >> np.arange(_BITS)) & 1, np.ones((len(shapes), 1), np.int64)), axis=1).astype(float)


def fit(rows: np.ndarray, n: np.ndarray, steps: int = 600, ridge: float = 1e-3) -> Field:
    """Weights of all three potentials that maximise the pseudo-likelihood of the configurations, by Adam steps.

    The ridge draws skip potentials to AGREE for equal labels, the others to 0.
    """
    x, y = _bits(rows[:, 0]), np.eye(_LABELS)[rows[:, -1]]
    one = np.vstack((np.eye(_LABELS), np.zeros(_LABELS)))  # -1 takes the last row
    left, right, near = one[rows[:, 1]], one[rows[:, 2]], rows[:, 3:-1].astype(float)
    share = (n / n.sum())[:, None]
    prior = AGREE * np.eye(_LABELS)
    params = [np.zeros((_BITS + 1, _LABELS)), np.zeros((_LABELS, _LABELS)), prior]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        w, c, s = params
        z = x @ w + left @ c + right @ c.T + near @ s
        p = np.exp(z - z.max(1, keepdims=True))
        off = share * (p / p.sum(1, keepdims=True) - y)
        skip = near.T @ off
        grads = [x.T @ off + ridge * w, left.T @ off + off.T @ right + ridge * c, skip + skip.T + ridge * (s - prior)]
        for k, g in enumerate(grads):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[k] = params[k] - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(*params)


def train(docs: DataFrame) -> Field:
    """Fit node, chain and skip weights on at most :data:`SAMPLE_DOCS` documents with a digit or an @.

    Without any such document the field labels nothing.
    """
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    # at most SAMPLE_DOCS numbers are broadcast; one text for each
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    # a row for each configuration among the sample's tokens
    counts = sample.select("text").mapInArrow(_counts, "what array<long>, n long").groupBy("what").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        weights = np.zeros((_BITS + 1, _LABELS))
        weights[-1, 0] = 10.0
        return Field(weights, np.zeros((_LABELS, _LABELS)), np.zeros((_LABELS, _LABELS)))
    return fit(np.array(counts.column("what").to_pylist(), np.int64), counts.column("n").to_numpy().astype(float))


def beliefs(field: Field, shapes: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Label probabilities of each token once the messages have settled; labels over 0 are known."""
    node = _bits(shapes) @ field.weights
    node -= node.max(1, keepdims=True)
    known = np.flatnonzero(labels > 0)
    node[known] = -50.0
    node[known, labels[known]] = 0.0
    ends = np.concatenate((chain, skip))
    if len(ends):
        table = np.concatenate((np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)))
        source, target = np.concatenate((ends[:, 0], ends[:, 1])), np.concatenate((ends[:, 1], ends[:, 0]))
        table = np.concatenate((table, table.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(ends), 2 * len(ends)), np.arange(len(ends))))
        message = np.zeros((len(source), node.shape[1]))
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[back])[:, :, None] + table
            top = out.max(1, keepdims=True)
            out = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            out -= out.max(1, keepdims=True)
            moved = np.abs(out - message).max()
            message = 0.5 * message + 0.5 * out
            if moved < SETTLED:
                break
        np.add.at(node, target, message)
    p = np.exp(node - node.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _spans(field: Field, texts: list[str]) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and further spans of each text."""
    base = [base_spans(t) for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    g = graph(texts, base)
    if g.tokens:
        p = beliefs(field, g.shapes, g.labels, g.chain, g.skip)
        best = p.argmax(1)
        for at in np.flatnonzero((best > 0) & (g.labels == 0) & (p.max(1) >= SURE)).tolist():
            i, a, b = g.tokens[at]
            more[i].append((a, int(best[at]) - 1, b))
    return base, more


def _found(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                base, more = _spans(field, [t or "" for t in part.column("text").to_pylist()])
                kinds = [Counter(k for _, k, _ in b) for b in base]
                rest = [part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rest,
                        *(pa.array([c[k] for c in kinds], pa.int64()) for k in range(len(KINDS))),
                        pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]),
                        pa.array([written(sorted(b + m)) for b, m in zip(base, more, strict=True)], pa.string()),
                    ],
                    [*part.schema.names, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    return run


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Personal data in every whole text of ``doc_id``, ``text``.

    Returns ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base
    spans), ``base_sha256`` and ``spans`` (all, as kind:start:end in code
    points). Null texts are empty and have none; each input row gives one row;
    other columns are ignored; texts of any length are read whole; an empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = field or train(docs)
    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.mapInArrow(_found(field), schema).drop("text")


def _masked(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1000):
                texts = batch.column("text").slice(at, 1000).to_pylist()
                base, more = _spans(field, [t or "" for t in texts])
                for text, b, m in zip(texts, base, more, strict=True):
                    if b or m:
                        parts, done = [], 0
                        for start, kind, end in sorted(b + m):
                            if end > done:
                                parts += [text[done : max(start, done)], f"<{KINDS[kind]}>"] if start >= done else []
                                done = max(done, end)
                        text = "".join([*parts, text[done:]])
                    out.append(text)
            columns = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in angle brackets.

    All columns stay; ``n_chars`` (if it is there) is brought up to date. Null
    texts stay null; of overlapping spans the first start counts and the rest
    is cut with it.
    """
    field = field or train(docs)
    out = docs.withColumn("text", F.col("text").cast("string"))
    out = out.mapInArrow(_masked(field), out.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
