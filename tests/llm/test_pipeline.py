from collections import Counter

import __spark_entry__
import corpus_pipeline
from gneiss.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text, "en", "s", len(text)), (3, text, "en", "s", len(text)), (3, text, "en", "s", len(text)), (9, text + " more", "en", "s", 0), (None, text, "en", "s", 0), (11, "other words here", None, None, None), (12, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert kept == Counter([3, None, 11, 12])


def test_texts_of_one_doc_id_are_judged_one_by_one(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (3, a), (3, b), (4, c), (4, c + " more"), (5, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id, r.text[:2]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert kept == [(1, "a0"), (3, "b0"), (4, "c0")]


def test_every_number_has_its_query():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in names)] == [] and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
