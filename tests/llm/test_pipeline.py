"""The pipeline's stages on a small table."""

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        after = docs.count()
        assert 0 < after <= before, name
        before = after
    pieces = corpus_pipeline.run(spark, FOLDER)
    assert pieces.select("doc_id").distinct().count() == before
