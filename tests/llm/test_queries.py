import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillbook.llm import queries

from oracle import connect, same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    same(spark, connect(DATA), queries.queries()[name], queries.oracle_sql()[name], DATA)


def test_pipeline(spark, documents):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == documents.columns and out.dtypes == documents.dtypes
        kept.append(out.count())
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    run = corpus_pipeline.run(spark, DATA)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*keys).collect())) == sorted(map(tuple, last.select(*keys).collect()))
    assert documents.count() >= kept[0] >= kept[1] >= kept[2] == kept[3] == run.select("doc_id").distinct().count()
    assert kept[1] < kept[0]


def test_pipeline_edges(spark, nasty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nasty, DATA)
        if name != "packing":
            assert out.columns == nasty.columns
        assert out.count() > 0 and stage(spark, nasty.limit(0), DATA).count() == 0
    exact = corpus_pipeline.drop_exact_copies(spark, nasty, DATA)
    assert exact.where("doc_id IN (1, 2, 3) OR text = 'same text here'").count() == 1
    masked = corpus_pipeline.mask_secrets(spark, nasty, DATA).where(F.col("doc_id") == 2**60).first()
    assert masked.text == "[SECRET]'" and masked.n_chars == len(masked.text) and masked.key == 0
    assert corpus_pipeline.mask_secrets(spark, nasty, DATA).where("doc_id = 4").first().text is None
