"""Queries of the subpackage against their SQL, and the pipeline, on the small tables."""

import pytest

import corpus_pipeline
from marginmill.llm import oracle, queries

from ..compare import differences, duck

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_query(spark, name):
    assert differences(queries.registered()[name](spark, DIRECTORY), duck(DIRECTORY), oracle.oracle_sql()[name]) == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, DIRECTORY), "test")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIRECTORY).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    run = corpus_pipeline.run(spark, DIRECTORY).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, packed))
