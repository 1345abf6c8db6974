"""Training-text pipeline: documents in, packed token sequences out.

Every stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and is written as Parquet and read again before the next. All stages but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import jaccard_join, line_dedup, packing, pii, toxicity
from gneiss.llm.tokenizer_files import tokenizer_path
from gneiss.sources.storage import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxicity_score < 0.5").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    return line_dedup.drop_recurring_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, the document of the smallest doc_id stays.

    Documents without doc_id, and those without words, stay; repeated rows of
    one document become one. Different texts under one doc_id are different
    documents: each is judged by its own text (of near texts under the
    smallest doc_id, the one of the smallest hash stays).
    """
    near = jaccard_join.near_duplicates(docs).where("doc_id is not null and n_shingles > 0")
    stays = near.where("doc_id = component_id").groupBy("component_id").agg(F.min("text_key").alias("first_key"))
    twins = near.where("doc_id = component_id").join(stays, "component_id").where("text_key <> first_key")
    extra = near.where("doc_id <> component_id").select("doc_id", "text_key").unionByName(twins.select("doc_id", "text_key")).distinct()
    extra = extra.withColumnRenamed("text_key", "__text_key")
    named = docs.where("doc_id is not null").withColumn("__text_key", F.xxhash64(F.col("text").cast("string")))
    named = named.join(extra, ["doc_id", "__text_key"], "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in sequences of 1024."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: A trained classifier and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
