"""Phrase collocations by contiguous pattern growth.

Words are 64-bit hashes of language and word; the word counts keep the least
and greatest word of each hash, so a clash is seen and all is hashed anew. Each
occurrence of a frequent word is projected onto its prefix: the words after it
in its piece, up to four. Equal projections of a chunk are one row with a
count. A prefix is dealt by its first word, so one task has all of its
occurrences and grows patterns to the right, depth first, over ranges of
them in order. A word in more occurrences than a task should hold is hot: its
projections are dealt by as many words as it takes to reach one that isn't, so
every longer pattern is still counted in one task, and patterns of hot words
alone are summed over tasks.

Frequent and hot words reach the chunks as bit sieves of fixed size. A word
that passes by chance costs work and changes nothing: counts decide about
frequency in the end, and hot words only about where counts are formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm import text as T
from gneiss.llm.sieve import passes, sieve
from gneiss.llm.word_bpe import _ranges
from gneiss.operators.order import positions
from gneiss.sources.storage import materialize

#: Words of a phrase at most, occurrences of a phrase at least, phrases of a language in the report.
LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: Bytes of text in a chunk, and those hashed at a time (a longer text stands alone).
CHUNK_BYTES, HASHED_BYTES = 8 << 20, 1 << 20
#: Projections of a task; a word in more occurrences is hot.
TASK_ROWS = 3_000_000
#: Packets that projections are dealt into at most; more tasks are reached in a second deal.
FAN = 256
#: Drop a phrase if a longer one around it has at least so many hundredths of its occurrences.
INSIDE = 100

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUTS = np.zeros(256, bool)
_CUTS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _CUTS.copy()
_GAPS[[32, 9]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, piece and row of each word of lower-cased texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    ink = ~_GAPS[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first = begins[:-1].copy()
    first[1:] |= ~ink[:-1]
    last = begins[1:].copy()
    last[:-1] |= ~ink[1:]
    last[-1] = True
    start, end = np.flatnonzero(ink & first), np.flatnonzero(ink & last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    piece = np.searchsorted(np.flatnonzero(_CUTS[data]), start) + row
    return start, end, piece, row


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray, attempt: int) -> np.ndarray:
    """Hash of language and word; each attempt has other clashes."""
    if not attempt:
        return T.mix(T.span_hash(T.prefix_hash(data), start, end) ^ lang)
    whole = data.tobytes()
    own = (xxhash.xxh3_64_intdigest(whole[a:b], attempt) for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return T.mix(np.fromiter(own, np.uint64, len(start)) ^ lang)


def _langs(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, which one each row has, and a hash of each."""
    coded = column.fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    return names, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))


def _chunked(batches: Iterator[pa.RecordBatch], attempt: int, hashed: Callable, chunk_bytes: int, hashed_bytes: int):
    """Chunks of texts in lower case: bytes, languages, and starts, ends, piece, row and hash of each word."""
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        for a, b in T.slices(offsets, chunk_bytes):
            own, at = _LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            names, code, lang = _langs(batch.column("lang")[a:b])
            start, end, piece, row = words(own, at)
            hashes = np.empty(len(start), np.uint64)
            for x, y in T.slices(at, hashed_bytes):
                i, j = np.searchsorted(start, (at[x], at[y]))
                hashes[i:j] = hashed(own[at[x] : at[y]], start[i:j] - at[x], end[i:j] - at[x], lang[code[row[i:j]]], attempt)
            yield own, names, code, start, end, piece, row, hashes


_COUNTS = ["word", "lang", "form", "n"]


def _counted(attempt: int):
    """Each chunk's distinct words with how often they occur, and the words of each language (no form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, names, code, start, end, _, row, hashes in _chunked(batches, attempt, _word_hashes, CHUNK_BYTES, HASHED_BYTES):
            hashes, first, n = np.unique(hashes, return_index=True, return_counts=True)
            size = end[first] - start[first]
            spelled = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(data[_ranges(start[first], size)].copy()))
            own = pa.array(names, pa.string()).take(pa.array(code[row[first]], pa.int64()))
            yield pa.RecordBatch.from_arrays([T.signed(hashes), own, spelled.cast(pa.string()), pa.array(n, pa.int64())], _COUNTS)
            each = np.bincount(code[row], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int64()), pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), pa.array(each, pa.int64())], _COUNTS)

    return run


class _Projections:
    """Rows of up to LONGEST words, each a place in ``known`` (hashes, 0: no word), with a count."""

    def __init__(self, known: np.ndarray, local: np.ndarray, n: np.ndarray):
        self.known, self.local, self.n = known, local, n

    @classmethod
    def of(cls, parts: list[_Projections]) -> _Projections:
        """Several as one: words by how often they are there, rows in order, equal rows summed."""
        known = np.unique(np.concatenate([np.zeros(1, np.uint64), *(p.known for p in parts)]))
        local = np.concatenate([np.searchsorted(known, p.known).astype(np.uint32)[p.local] for p in parts])
        n = np.concatenate([p.n for p in parts])
        times = np.bincount(local.reshape(-1), minlength=len(known))
        times[0] = -1  # no word comes last, so shorter rows follow longer ones
        frequent = np.argsort(-times, kind="stable")
        place = np.empty(len(known), np.uint32)
        place[frequent] = np.arange(len(known), dtype=np.uint32)
        known, local = known[frequent], place[local]
        if len(known) < 1 << 21:
            first, second = (local[:, i].astype(np.uint64) << np.uint64(42) | local[:, i + 1].astype(np.uint64) << np.uint64(21) | (local[:, i + 2] if i + 2 < LONGEST else np.uint32(0)) for i in (0, 3))
            order = np.lexsort((second, first))
        else:
            order = np.lexsort(local.T[::-1])
        local, n = local[order], n[order]
        new = np.ones(len(local), bool)
        new[1:] = (local[1:] != local[:-1]).any(axis=1)
        return cls(known, local[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n)

    @classmethod
    def read(cls, packet: pa.Scalar) -> _Projections:
        data = zstandard.ZstdDecompressor().decompress(packet.as_buffer())
        k, rows, width = np.frombuffer(data, np.int64, 3).tolist()
        planes = np.frombuffer(data, np.uint8, LONGEST * rows * width, 24 + 8 * k).reshape(width, -1)
        local = np.ascontiguousarray(planes.T).view(np.uint16 if width == 2 else np.uint32).reshape(LONGEST, rows).T
        return cls(np.frombuffer(data, np.uint64, k, 24), local.astype(np.uint32), np.frombuffer(data, np.int64, rows, 24 + 8 * k + LONGEST * rows * width))

    def packet(self, rows: np.ndarray) -> bytes:
        """Some rows, compressed by columns and byte planes with the words that they have."""
        local = self.local[rows]
        used = np.zeros(len(self.known), bool)
        used[local] = True
        local = (np.cumsum(used) - 1)[local]
        kind = np.uint16 if used.sum() < 1 << 16 else np.uint32
        planes = np.ascontiguousarray(local.T.astype(kind)).reshape(-1).view(np.uint8).reshape(-1, kind(0).itemsize).T
        head = np.array([used.sum(), len(local), kind(0).itemsize], np.int64)
        return zstandard.ZstdCompressor(level=3).compress(b"".join((head.tobytes(), self.known[used].tobytes(), np.ascontiguousarray(planes).tobytes(), self.n[rows].tobytes())))

    def shard(self, hot: np.ndarray, shards: int) -> np.ndarray:
        """Where rows are dealt: by their words up to the first that isn't hot."""
        hot = passes(hot, self.known)
        key, more = T.mix(self.known[self.local[:, 0]]), hot[self.local[:, 0]]
        for j in range(1, LONGEST):
            word = self.known[self.local[:, j]]
            more = more & (word != 0)
            key = np.where(more, T.mix(key * np.uint64(0x2545F4914F6CDD1D) + word), key)
            more &= hot[self.local[:, j]]
        return (key % np.uint64(shards)).astype(np.int64)

    def dealt(self, hot: np.ndarray, shards: int, digit: int) -> Iterator[pa.RecordBatch]:
        """Packets by shard, or by groups of ``digit`` shards."""
        shard = self.shard(hot, shards) // digit
        order = np.argsort(shard, kind="stable")
        used, start = np.unique(shard[order], return_index=True)
        ends = [*start[1:].tolist(), len(order)][: len(used)]
        for s, a, b in zip(used.tolist(), start.tolist(), ends, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([self.packet(order[a:b])], pa.binary())], ["shard", "packet"])


def _dealt(found: Iterator[_Projections], hot: np.ndarray, shards: int, digit: int, most: int) -> Iterator[pa.RecordBatch]:
    """Packets of projections, ``most`` or so put together first."""
    parts, size = [], 0
    for p in found:
        parts.append(p)
        size += len(p.n)
        if size >= most:
            yield from _Projections.of(parts).dealt(hot, shards, digit)
            parts, size = [], 0
    if parts:
        yield from _Projections.of(parts).dealt(hot, shards, digit)


def _projected(attempt: int, frequent: Broadcast, hot: Broadcast, shards: int, digit: int):
    """Projections of a task's frequent words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[_Projections]:
        for _, _, _, _, _, piece, _, hashes in _chunked(batches, attempt, _word_hashes, CHUNK_BYTES, HASHED_BYTES):
            kept = passes(frequent.value, hashes) & (hashes != 0)
            # a word that isn't frequent ends a run, as the end of a piece does
            run_ = np.cumsum(np.concatenate(([True], piece[1:] != piece[:-1])) | ~kept) if len(piece) else piece
            known, word = np.unique(hashes[kept], return_inverse=True)
            run_, word = run_[kept], word + 1
            local = np.zeros((len(word), LONGEST), np.uint32)
            local[:, 0] = word
            for j in range(1, LONGEST):
                local[:-j, j] = np.where(run_[j:] == run_[:-j], word[j:], 0)
            local = local[local[:, 1] != 0]
            yield _Projections(np.concatenate((np.zeros(1, np.uint64), known)), local, np.ones(len(local), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt(found(batches), hot.value, shards, digit, TASK_ROWS)

    return run


def _second_deal(hot: Broadcast, shards: int):
    """Packets of groups of shards, put together and dealt by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt((_Projections.read(p) for batch in batches for p in batch.column("packet")), hot.value, shards, 1, TASK_ROWS)

    return run


def _grown(hot: Broadcast, min_count: int):
    """Patterns of a shard's projections with their counts."""

    def run(table: pa.Table) -> pa.Table:
        rows = _Projections.of([_Projections.read(p) for p in table.column("packet")])
        none, hot_words = int(np.flatnonzero(rows.known == 0)[0]), passes(hot.value, rows.known)
        upto = np.concatenate(([0], np.cumsum(rows.n)))
        phrases, counts = [], []

        def grow(first: int, last: int, prefix: tuple[int, ...], summed: bool) -> None:
            """All patterns that go on from ``prefix``, whose projections are rows ``first`` to ``last``; ``summed``: its words are hot, other tasks may count it too."""
            depth = len(prefix)
            following = rows.local[first:last, depth]
            starts = first + np.flatnonzero(np.concatenate(([True], following[1:] != following[:-1])))
            ends = np.append(starts[1:], last)
            sums = upto[ends] - upto[starts]
            kept = (sums >= min_count) | (hot_words[rows.local[starts, depth]] if summed else False)
            for a, b, count in zip(starts[kept].tolist(), ends[kept].tolist(), sums[kept].tolist(), strict=True):
                word = int(rows.local[a, depth])
                partly = summed and bool(hot_words[word]) and depth + 1 < LONGEST
                if word == none or (count < min_count and not partly):
                    continue
                longer = (*prefix, word)
                if depth:
                    phrases.append(longer)
                    counts.append(count)
                if depth + 1 < LONGEST:
                    grow(a, b, longer, partly)

        if len(rows.n):
            grow(0, len(rows.n), (), True)
        big = rows.known.astype(">u8")
        return pa.table({"phrase": pa.array([big[list(p)].tobytes() for p in phrases], pa.binary()), "n": pa.array(counts, pa.int64())})

    return run


def _key(word: Column) -> Column:
    """A word's hash as the bytes of a phrase."""
    return F.unhex(F.lpad(F.hex(word), 16, "0"))


def frequent_words(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, int]:
    """Words in ``min_count`` occurrences of a language with their hashes; words of each language; the attempt that had no clash.

    Words that share a hash are apart in language or form. Where they have too
    few occurrences together, no phrase with one of them is a candidate.
    """
    for attempt in range(9):
        counts = docs.mapInArrow(_counted(attempt), "word long, lang string, form string, n long")
        # words of a language are counted by its name, words by their hash
        key = F.when(F.col("form").isNull(), F.col("lang"))
        counts = counts.groupBy(key.alias("of"), F.when(F.col("form").isNotNull(), F.col("word")).alias("word"))
        counts = counts.agg(F.sum("n").alias("n"), F.min(F.struct("lang", "form")).alias("least"), F.max(F.struct("lang", "form")).alias("most"))
        counts = materialize(counts, "word_counts")
        own = counts.where("of is null")
        if own.where((F.col("n") >= min_count) & (F.col("least") != F.col("most")) | (F.col("word") == 0)).first() is None:
            langs = counts.where("of is not null").select(F.col("of").alias("lang"), "n")
            return own.where(F.col("n") >= min_count).select("word", "n", "least.lang", "least.form"), langs, attempt
    raise ArithmeticError("word hashes clash under every seed")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words and phrases (``phrase``: hashes end to end) with their counts; words; words of each language."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known, langs, attempt = frequent_words(docs, min_count)
    total = known.agg(F.sum("n")).first()[0] or 0
    frequent, hot = sieve(known, "word"), sieve(known.where(F.col("n") > TASK_ROWS), "word")
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    digit = -(-shards // FAN)
    packets = docs.mapInArrow(_projected(attempt, frequent, hot, shards, digit), "shard long, packet binary")
    if digit > 1:
        packets = packets.repartition("shard").mapInArrow(_second_deal(hot, shards), "shard long, packet binary")
    grown = packets.groupBy("shard").applyInArrow(_grown(hot, min_count), "phrase binary, n long")
    grown = grown.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    counts = materialize(grown.unionByName(known.select(_key(F.col("word")).alias("phrase"), "n")), "phrases")
    frequent.unpersist()
    hot.unpersist()
    return counts, known, langs


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut.

    Texts (null: empty) are lower-cased in A-Z and cut into pieces at
    ``.,;:!?`` and line ends, pieces into words at blanks and tabs. Phrases of
    2 to 5 words in ``min_count`` occurrences are candidates; cut after k words
    with l and r occurrences of the parts, a phrase of a occurrences among n
    words scores floor(1000 a n / (l r)) in whole numbers of 38 digits; the
    least score counts, of equal ones that of the smallest k. Candidates inside
    a longer one of at least ``inside`` hundredths of their occurrences go.
    Returns ``lang`` (null: und), ``rank``, ``phrase``, ``a``, ``l``, ``r``,
    ``n`` and ``score``, ranked by score, a and the bytes of the phrase. Copies
    and repeated rows count as often as they are there; other columns are
    ignored; an empty table gives an empty result.
    """
    counts, known, langs = phrase_counts(docs, min_count)
    size = F.octet_length("phrase") / 8
    candidates = counts.where(size > 1).withColumn("m", size.cast("int"))
    # what is inside a phrase of two more words is inside one of one more with as many occurrences or more
    parts = candidates.where("m > 2").select(F.explode(F.array(F.expr("substring(phrase, 1, 8 * (m - 1))"), F.expr("substring(phrase, 9)"))).alias("part"), "n")
    around = parts.groupBy("part").agg(F.max("n").alias("around"))
    candidates = candidates.join(around, candidates["phrase"] == around["part"], "left").where(F.coalesce(100 * F.col("around") < inside * F.col("n"), F.lit(True)))
    cuts = candidates.select("phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring(phrase, 1, 8 * k)")).withColumn("right", F.expr("substring(phrase, 8 * k + 1)"))
    cuts = cuts.join(counts.select(F.col("phrase").alias("left"), F.col("n").alias("l")), "left").join(counts.select(F.col("phrase").alias("right"), F.col("n").alias("r")), "right")
    spoken = known.select(_key(F.col("word")).alias("word"), "lang", "form")
    cuts = cuts.withColumn("first", F.expr("substring(phrase, 1, 8)")).join(spoken.select(F.col("word").alias("first"), "lang"), "first").join(langs.withColumnRenamed("n", "words"), "lang")
    score = F.expr("cast(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(words as decimal(38,0)) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as long)")
    cuts = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("cut")).select("lang", "phrase", "cut.*")
    scored = materialize(cuts, "scored")

    # phrases are spelled only where score and a can still be among the first
    place = positions(scored.select("lang", "score", "a"), F.desc("score"), F.desc("a"), by=["lang"], name="at")
    last = place.where(F.col("at") < top).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last"))
    near = scored.join(last, "lang").where(F.struct("score", "a") >= F.col("last")).drop("last")
    each = near.withColumn("m", (F.octet_length("phrase") / 8).cast("int")).select("*", F.posexplode(F.sequence(F.lit(0), F.col("m") - 1)).alias("at", "i"))
    each = each.withColumn("word", F.expr("substring(phrase, 8 * i + 1, 8)")).join(spoken.select("word", "form"), "word")
    spelled = each.groupBy("lang", "phrase", "score", "a", "l", "r", "words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "form"))), lambda x: x["form"]), " ").alias("spelled"))
    ranked = positions(spelled, F.desc("score"), F.desc("a"), F.asc("spelled"), by=["lang"], name="at").where(F.col("at") < top)
    return ranked.select("lang", (F.col("at") + 1).alias("rank"), F.col("spelled").alias("phrase"), "a", "l", "r", F.col("words").alias("n"), "score")


def oracle() -> str:
    """The same report as DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " union all ".join(
        f"select lang, {m} as m, concat_ws(' ', {', '.join(f'w{i}' for i in range(m))}) as phrase, count(*) as n from spread where w{m - 1} is not null group by all having count(*) >= {MIN_COUNT}"
        for m in range(2, LONGEST + 1)
    )
    leads = ", ".join(f"lead(word, {i}) over piece as w{i}" for i in range(1, LONGEST))
    return f"""
    with texts as (select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{upper}', '{lower}') as text from documents),
    pieces as (select id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece, generate_subscripts(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]'), 1) as part from texts),
    listed as (select id, lang, part, regexp_extract_all(piece, '[^ \\t]+') as words from pieces),
    words as (select id, lang, part, unnest(words) as word, generate_subscripts(words, 1) as pos from listed),
    spread as (select lang, word as w0, {leads} from words window piece as (partition by id, part order by pos)),
    sizes as (select lang, count(*) as n from words group by lang),
    counts as materialized (select lang, 1 as m, word as phrase, count(*) as n from words group by lang, word having count(*) >= {MIN_COUNT} union all {grams}),
    inner_parts as (
        select lang, array_to_string(string_split(phrase, ' ')[1:m - 1], ' ') as phrase, n from counts where m > 2
        union all select lang, array_to_string(string_split(phrase, ' ')[2:m], ' '), n from counts where m > 2),
    around as (select lang, phrase, max(n) as most from inner_parts group by all),
    kept as (select c.* from counts c left join around a using (lang, phrase) where c.m > 1 and (a.most is null or 100 * a.most < {INSIDE} * c.n)),
    cuts as (select *, unnest(range(1, m)) as k from kept),
    scored as (
        select c.lang, c.phrase, c.n as a, x.n as l, y.n as r, s.n as n, k, cast(1000 as hugeint) * c.n * s.n // (cast(x.n as hugeint) * y.n) as score
        from cuts c join sizes s using (lang)
        join counts x on x.lang = c.lang and x.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
        join counts y on y.lang = c.lang and y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:c.m], ' ')),
    weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weakest)
    select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
    from ranked where rank <= {TOP}"""
