"""The pipeline's stages on a small table."""

import corpus_pipeline
from girderframe.llm import catalog
from girderframe.session import stored

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("label", corpus_pipeline.F.lit("x"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii_surrogates", "mixing"]
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SMALL), "test_" + name)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        assert name == "mixing" or out.columns == docs.columns
        before, docs = set(ids), out
    assert {"repeats", "target"} <= set(docs.columns)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), "empty_" + name)
        assert docs.count() == 0


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in catalog.QUERIES} == {f"op{n}" for n in range(1, 14)}
