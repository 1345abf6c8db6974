"""Canonical exact digests of documents.

A text's canonical form is NFKC, case-folded, with runs of white space as one
blank; its fingerprint is the 128-bit xxh3 of that form. Documents are grouped
by fingerprint, and inside a group of several documents the canonical bytes
themselves are compared: should two forms ever share a digest, all but the
first get an ordinal added, so equal fingerprints mean equal forms.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.sieve import passes, sieve
from gneiss.sources.storage import materialize

#: Bytes of text that a task sorts.
TASK_BYTES = 48 << 20


def canonical(text: str | None) -> str:
    """NFKC, case and white space folded; null is empty."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.casefold().split())


def digest(form: str) -> str:
    """Fingerprint of a canonical form: 32 hexadecimal digits."""
    return xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass"))


def _compare(doc: tuple, following: str, following_form: str, following_digest: str) -> dict:
    """A document's row, from (doc_id, text, form, digest) and its successor."""
    doc_id, text, form, own = doc
    third = len(text) // 3
    edited = text[: len(text) - third] + following[:third]
    edited_form = canonical(edited)
    edited_digest = digest(edited_form)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": own,
        "edited_fingerprint": edited_digest,
        # an exact digest is alike or not; equal digests are compared by bytes
        "near_edited": float(own == edited_digest and form == edited_form),
        "near_next": float(own == following_digest and form == following_form),
    }


_ROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
_EDGE = [("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition; its first and last document also as edges."""
    part, before, schema = TaskContext.get().partitionId(), None, pa.schema([*_ROW, *_EDGE])
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            form = canonical(text)
            own = digest(form)
            if before is None:
                rows.append({"doc_id": doc_id, "text": text, "part": part, "edge": "first"})
            else:
                rows.append(_compare(before, text, form, own))
            before = (doc_id, text, form, own)
        yield pa.RecordBatch.from_pylist(rows, schema)
    if before is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": before[0], "text": before[1], "part": part, "edge": "last"}], schema)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents whose successor is in another partition."""
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            form, following = canonical(x["text"]), canonical(x["following"])
            rows.append(_compare((x["doc_id"], x["text"], form, digest(form)), x["following"], following, digest(following)))
        yield pa.RecordBatch.from_pylist(rows, _ROW)


def _key(digests: F.Column | str) -> F.Column:
    return F.xxhash64(digests)


def _forms(wanted):
    """Canonical forms of the documents whose digest may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            forms = [canonical(t.as_py()) for t in batch.column("text")]
            owns = [digest(f) for f in forms]
            keys = np.array([int(d[16:], 16) for d in owns], np.uint64)
            keep = np.flatnonzero(passes(wanted.value, keys)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([owns[i] for i in keep], pa.string()), pa.array([forms[i] for i in keep], pa.string())],
                ["doc_id", "fingerprint", "form"],
            )

    return run


def _collisions(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents whose digest is shared by another form, with the ordinal of theirs."""
    spark = docs.sparkSession
    repeated = materialize(rows.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "repeated")
    low = repeated.select(F.expr("cast(conv(substr(fingerprint, 25), 16, 10) as long)").alias("low"))
    forms = docs.mapInArrow(_forms(sieve(low, "low")), "doc_id long, fingerprint string, form string").join(repeated, "fingerprint", "left_semi")
    distinct = forms.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("first_id"))
    shared = materialize(distinct.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "collisions")
    if not shared.limit(1).count():
        return spark.createDataFrame([], "doc_id long, fingerprint string, ordinal int")
    nth = F.dense_rank().over(Window.partitionBy("fingerprint").orderBy("form")) - 1
    return forms.join(shared, "fingerprint").select("doc_id", "fingerprint", nth.alias("ordinal")).distinct()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text, and how it compares with an edited text.

    The edited text has its last third replaced by the beginning of the next
    document in descending order of doc_id (the last one's next is the first).
    Likeness is 1 for equal canonical forms, else 0. Null texts are empty;
    null doc_ids come last; repeated doc_ids are ordered by text; one row for
    each input row; an empty table gives an empty result. Only ``doc_id`` and
    ``text`` are read. Texts of any length are used whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    sorted_docs = docs.repartitionByRange(max(8, int(size) // TASK_BYTES), order[0]).sortWithinPartitions(*order)
    walked = materialize(sorted_docs.mapInArrow(_walk, _COLUMNS + ", part int, edge string, text string"), "fingerprints")

    first = walked.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    # part numbers only, one for each task of the sort
    last = walked.where("edge = 'last'").select("part")
    turn = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    last = last.withColumn("next_part", turn)
    tails = walked.where("edge = 'last'").select("part", "doc_id", "text").join(last, "part").join(first, "next_part")
    rows = walked.where("edge is null").drop("part", "edge", "text")
    rows = rows.unionByName(tails.select("doc_id", "text", "following").mapInArrow(_across, _COLUMNS))
    rows = materialize(rows, "fingerprints")

    ordinals = _collisions(docs, rows)
    rows = rows.join(ordinals, ["doc_id", "fingerprint"], "left")
    named = F.when(F.coalesce("ordinal", F.lit(0)) > 0, F.concat_ws("-", "fingerprint", F.col("ordinal").cast("string"))).otherwise(F.col("fingerprint"))
    return rows.withColumn("fingerprint", named).drop("ordinal")
