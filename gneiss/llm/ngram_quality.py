"""Quality by an interpolated modified Kneser-Ney n-gram model.

The model is over the characters of the running text: lower case, one blank
after each word, and the first characters of a word see the end of the word
before. It is trained on all trusted documents but those held out for the
thresholds. What the characters of a word depend on is the word and the last
TAIL characters before it, a unit: documents are kept as bags of units, chunk
by chunk. A chunk's distinct n-grams are dealt by hash over shards, shards join
them with the model's count table, and their log probabilities go back to the
chunk, where a document's perplexity is the exponential of its mean negative
log probability per character.

A document is kept if its perplexity is at most its language's threshold: a
quantile of the perplexities of that language's held-out trusted documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm import text as T
from gneiss.llm.sieve import passes, sieve
from gneiss.llm.word_bpe import _squeeze, _stretch
from gneiss.sources.storage import materialize

#: Characters of an n-gram; the log base is e.
ORDER = 4
#: Characters of the word before that a word's first characters see, one at least; more of them make more distinct units to move.
TAIL = 1
#: One in HELD_OUT trusted documents is left out of training, and gives the threshold: the QUANTILE of its language.
HELD_OUT, QUANTILE = 10, 0.98
#: Bytes of text in a chunk (a longer text stands alone), and bytes of text for each shard of n-grams.
CHUNK_BYTES, SHARD_BYTES = 8 << 20, 128 << 20
#: Units that a task turns into n-grams at once, and steps of a rounded log probability.
SLICE_UNITS, STEPS = 100_000, 4096
#: Bits (a power) of the sieve that picks training texts before they are joined.
SIEVE_BITS = 25
#: Languages whose thresholds are sent as literals; more are joined.
MAX_LITERALS = 1_000
#: Stands before the first word; white space, so it is in no word.
_OPEN = "\r"


def units(text: str) -> list[str]:
    """Each word (lower case) behind the ORDER - 1 characters that its first one sees."""
    words = text.lower().split()
    ends = [w[-TAIL:].rjust(TAIL, _OPEN) for w in words[:-1]] if TAIL > 1 else [w[-1] for w in words[:-1]]
    pad = _OPEN * (ORDER - 2 - TAIL)
    return [_OPEN * (ORDER - 1) + w for w in words[:1]] + [f"{pad}{e} {w}" for e, w in zip(ends, words[1:], strict=True)]


def grams(unit: str) -> list[str]:
    """The n-gram that ends at each character of a unit's word and at the blank after it."""
    padded = unit + " "
    return [padded[i : i + ORDER] for i in range(len(padded) - ORDER + 1)]


def _compact(key: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Equal keys (below ``top``) as equal numbers from 0, and how many there are."""
    if top > 1 << 24:
        distinct, number = np.unique(key, return_inverse=True)
        return number, len(distinct)
    seen = np.zeros(top, bool)
    seen[key] = True
    number = np.cumsum(seen, dtype=np.int32) - 1
    return number[key].astype(np.int64), int(number[-1]) + 1 if top else 0


def _numbers(distinct: list[str]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """For slices of units: the first one, their distinct n-grams, and n-gram and unit of each character."""
    for at in range(0, len(distinct), SLICE_UNITS):
        own = distinct[at : at + SLICE_UNITS]
        size = np.fromiter(map(len, own), np.int64, len(own)) + 1
        code = np.frombuffer((" ".join(own) + " ").encode("utf-32-le"), np.uint32)
        index, letters = _compact(code, int(code.max()) + 1)
        unit = np.repeat(np.arange(len(own)), size - ORDER + 1)
        ends = np.arange(len(unit)) + (unit + 1) * (ORDER - 1)
        key = index[ends - ORDER + 1]
        for j in range(ORDER - 2, -1, -1):
            key, n = _compact(key * letters + index[ends - j], (int(key.max()) + 1) * letters)
        one = np.empty(n, np.int64)
        one[key] = ends
        spelled = np.stack([code[one - j] for j in range(ORDER - 1, -1, -1)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        yield at, pa.array([spelled[i : i + ORDER] for i in range(0, len(spelled), ORDER)], pa.string()), key, unit


def _bags(texts: pa.Array) -> tuple[list[str], list[np.ndarray], list[int]]:
    """Distinct units of some texts, the units of each text by number, and its characters."""
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__  # a new unit gets the next number
    at, chars = [], []
    for text in texts:
        own = units(text.as_py() or "")
        at.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        chars.append(sum(map(len, own)) - (ORDER - 2) * len(own))
    known.default_factory = None  # else the table refers to itself and is kept until the next collection of cycles
    return list(known), at, chars


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of texts with their counts, added up for each slice."""
    for batch in batches:
        _, offsets = T.utf8(batch.column("text"))
        for a, b in T.slices(offsets, CHUNK_BYTES):
            names, at, _ = _bags(batch.column("text").slice(a, b - a))
            count = np.bincount(np.concatenate(at), minlength=len(names))
            for first, spelled, number, unit in _numbers(names):
                yield pa.RecordBatch.from_arrays([spelled, pa.array(np.bincount(number, count[first + unit]).astype(np.int64))], ["gram", "n"])


_ASKED = pa.list_(pa.struct([("shard", pa.int32()), ("grams", pa.binary())]))
_CHUNK = "doc_ids array<long>, langs array<string>, chars array<long>, counts array<int>, steps binary, times binary, units binary, asked array<struct<shard: int, grams: binary>>"


def _pack(texts: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress("\n".join(texts).encode())


def _unpack(packed: pa.Scalar) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(packed.as_buffer()).decode()
    return text.split("\n") if text else []


def _chunk(docs: pa.RecordBatch, shards: int) -> pa.RecordBatch:
    """Distinct units, each document as a bag of their numbers, and the n-grams of the units by shard."""
    names, at, chars = _bags(docs.column("text"))
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    names = [names[i] for i in order.tolist()]
    doc = np.repeat(np.arange(len(at)), [len(x) for x in at])
    bag, times = np.unique(doc * max(len(names), 1) + place[np.concatenate(at)], return_counts=True)
    doc, number = bag // max(len(names), 1), bag % max(len(names), 1)
    step = np.diff(number, prepend=-1)
    new = np.diff(doc, prepend=-1) != 0
    step[new] = number[new] + 1
    wanted: set[str] = set()
    for _, spelled, _, _ in _numbers(names):
        wanted.update(spelled.to_pylist())
    by_shard: dict[int, list[str]] = {}
    for g in sorted(wanted):
        by_shard.setdefault(xxhash.xxh3_64_intdigest(g) % shards, []).append(g)
    asked = [{"shard": k, "grams": _pack(v)} for k, v in sorted(by_shard.items())]
    lists = [pa.ListArray.from_arrays(pa.array([0, docs.num_rows], pa.int32()), docs.column(c)) for c in ("doc_id", "lang")]
    counts = np.bincount(doc, minlength=docs.num_rows).tolist()
    packed = [pa.array([x], pa.binary()) for x in (_squeeze(step, 9), _squeeze(times, 9), _pack(names))]
    return pa.RecordBatch.from_arrays(
        [*lists, pa.array([chars], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), *packed, pa.array([asked], _ASKED)],
        ["doc_ids", "langs", "chars", "counts", "steps", "times", "units", "asked"],
    )


def _chunks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = T.utf8(batch.column("text"))
            for a, b in T.slices(offsets, CHUNK_BYTES):
                yield _chunk(batch.slice(a, b - a), shards)

    return run


def _wanted(table: pa.Table) -> pa.Table:
    """Distinct n-grams that are asked of a shard."""
    grams = sorted({g for packed in table.column("grams") for g in _unpack(packed)})
    return pa.table({"shard": pa.array(np.full(len(grams), table.column("shard")[0].as_py(), np.int32)), "gram": pa.array(grams, pa.string())})


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Interpolated modified Kneser-Ney log probability of every ``gram`` that is asked for.

    ``counts`` has ``gram`` (ORDER characters) and ``n`` (0: only asked for).
    Lower orders use continuation counts, discounts for counts of one, two and
    more come from the counts of counts of each order, and the lowest order is
    mixed with a uniform distribution over the characters seen.
    """
    level = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    levels = [materialize(level.withColumn("context", F.substring("gram", 1, ORDER - 1)), "grams")]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: different characters before
        up = levels[-1].groupBy(F.expr(f"substr(gram, 2, {k})").alias("gram")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n"))
        levels.append(materialize(up.withColumn("context", F.substring("gram", 1, k - 1)), "grams"))
    alphabet = max(1, levels[-1].where("n > 0").count())
    lower = None
    for level in reversed(levels):  # from single characters up
        c = level.agg(*(F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        n1, n2, n3, n4 = (max(x or 0, 1) for x in c)
        y = n1 / (n1 + 2 * n2)
        d1, d2, d3 = (min(max(v, 0.1), m - 0.05) for v, m in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3)))
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).when(F.col("n") > 2, d3).otherwise(0.0)
        own = level.withColumn("cut", cut).withColumn("all_n", F.sum("n").over(Window.partitionBy("context"))).withColumn("mass", F.sum("cut").over(Window.partitionBy("context")))
        if lower is None:
            below = own.withColumn("low", F.lit(1.0 / (alphabet + 1)))
        else:
            below = own.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), F.expr("substr(gram, 2)") == F.col("suffix")).drop("suffix")
        seen = (F.col("n") - F.col("cut")) / F.col("all_n") + F.col("mass") / F.col("all_n") * F.col("low")
        lower = materialize(below.select("gram", F.when(F.col("all_n") > 0, seen).otherwise(F.col("low")).alias("p")), "probabilities")
    return lower.select("gram", F.log("p").alias("logp"))


def _scored(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Cost (negative log probability in STEPS) of each chunk's n-grams from the shard's part of the model."""
    cost = np.rint(model.column("logp").to_numpy() * -STEPS).astype(np.uint32).tolist()
    cost = dict(zip(model.column("gram").to_pylist(), cost, strict=True))
    own = [_squeeze(np.fromiter(map(cost.__getitem__, _unpack(packed)), np.uint32)) for packed in asked.column("grams")]
    return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "cost": pa.array(own, pa.binary())})


def _documents(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    answer = dict(zip(answers.column("shard").to_pylist(), answers.column("cost"), strict=True))
    out = []
    for row in range(chunk.num_rows):
        asked = chunk.column("asked")[row]
        grams = pa.array([g for x in asked for g in _unpack(x["grams"])], pa.string())
        of_gram = np.concatenate([np.zeros(0), *(_stretch(answer[x["shard"].as_py()].as_buffer()) for x in asked)])
        names = _unpack(chunk.column("units")[row])
        of_unit = np.zeros(len(names))
        for at, spelled, number, unit in _numbers(names):
            found = of_gram[pc.index_in(spelled, value_set=grams).to_numpy()]
            n = min(SLICE_UNITS, len(names) - at)
            of_unit[at : at + n] = np.bincount(unit, found[number], n)
        counts = chunk.column("counts")[row].values.to_numpy()
        doc = np.repeat(np.arange(len(counts)), counts)
        step, times = (_stretch(chunk.column(c)[row].as_buffer()).astype(np.int64) for c in ("steps", "times"))
        run, ends = np.cumsum(step), np.cumsum(counts)
        before = np.where(ends > counts, run[np.maximum(ends - counts, 1) - 1], 0) if len(run) else ends
        total = np.bincount(doc, times * of_unit[run - before[doc] - 1], len(counts)) / -STEPS
        out.append(pa.table([*(chunk.column(c)[row].values for c in ("doc_ids", "langs", "chars")), pa.array(total)], names=["doc_id", "lang", "n_chars", "log_prob"]))
    return pa.concat_tables(out)


def perplexities(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``n_chars``, ``log_prob``, ``perplexity`` of every whole text of ``docs``.

    ``docs`` needs ``doc_id``, ``text`` and ``lang``; the model is trained on
    every whole ``text`` of ``training``. Null and empty texts have no
    characters and a null perplexity; one row for each input row. Log
    probabilities of n-grams are rounded to 1/STEPS.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(12, int(size) // SHARD_BYTES)
    chunks = materialize(docs.mapInArrow(_chunks(shards), _CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    asked = chunks.select("chunk", F.explode("asked").alias("asked")).select("chunk", "asked.*")
    wanted = materialize(asked.select("shard", "grams").groupBy("shard").applyInArrow(_wanted, "shard int, gram string"), "wanted_grams")
    counts = training.select(F.col("text").cast("string").alias("text")).mapInArrow(_training, "gram string, n long")
    counts = counts.groupBy("gram").agg(F.sum("n").alias("n")).unionByName(wanted.select("gram", F.lit(0).cast("long").alias("n")))
    model = wanted.join(kneser_ney(counts), "gram")
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_scored, "chunk long, shard int, cost binary")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_documents, "doc_id long, lang string, n_chars long, log_prob double")
    return scored.withColumn("perplexity", F.exp(-F.try_divide("log_prob", "n_chars")))


def _passing(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(wanted.value, batch.column("doc_id").to_numpy())))

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Perplexity of every document and whether its language's threshold keeps it.

    Trusted are the documents labelled ``quality`` 1 (a document labelled twice
    is trusted if no label says otherwise); those whose crc32(doc_id as text)
    mod :data:`HELD_OUT` is 0 are held out of training and give the
    thresholds. A language without held-out documents takes the threshold of
    all held-out ones, and where there are none at all that of all trusted
    ones; without trusted documents everything is kept. A null ``lang`` is a
    language of its own, shown as "". Ties at the threshold are kept. Empty
    documents are not kept. Other columns are ignored.
    """
    trusted = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("trusted"))
    trusted = trusted.where("trusted").select("doc_id", F.when(F.expr(f"pmod(crc32(cast(doc_id as string)), {HELD_OUT}) = 0"), 2).otherwise(1).alias("role"))
    trusted = materialize(trusted, "trusted")
    ids = trusted.where("role = 1").select("doc_id")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = texts.mapInArrow(_passing(sieve(ids, "doc_id", SIEVE_BITS)), texts.schema).join(ids, "doc_id", "left_semi")
    rows = perplexities(docs.select("doc_id", "text", "lang"), training).join(trusted, "doc_id", "left")
    rows = materialize(rows, "perplexities")
    known = rows.where("role > 0 and perplexity is not null")
    quantile = F.percentile_approx("perplexity", QUANTILE, 10_000)
    held, every = (known.where(c).agg(quantile).first()[0] for c in ("role = 2", "role > 0"))
    shared = F.lit(every if held is None else held).cast("double")
    per_lang = known.where("role = 2").groupBy("lang").agg(quantile.alias("own"))
    own = per_lang.limit(MAX_LITERALS + 1).collect()
    if len(own) > MAX_LITERALS:
        out = rows.join(per_lang, "lang", "left").withColumn("threshold", F.coalesce("own", shared))
    else:
        threshold = shared
        for r in own:
            threshold = F.when(F.col("lang") == r.lang, r.own).otherwise(threshold)
        out = rows.withColumn("threshold", threshold)
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_chars", "log_prob", "perplexity", "threshold", kept.alias("kept"))
