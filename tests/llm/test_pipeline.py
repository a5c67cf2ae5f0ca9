"""The corpus pipeline against its stages on one core of the small tables, and what must stay."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {x.doc_id: x for x in docs.collect()}
    ids = set(before)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        left = {x.doc_id for x in now.collect()}
        assert now.columns == list(corpus_pipeline.COLUMNS) and left <= ids, name
        ids = left
    for x in now.collect():
        assert x.n_chars == len(x.text)
        if "@" not in before[x.doc_id].text and not any(c.isdigit() for c in before[x.doc_id].text):
            assert x.text == before[x.doc_id].text
    out = corpus_pipeline.run(spark, SF).collect()
    assert {x.doc_id for x in out} == ids and all(x.lossless for x in out)
    assert len(ids) > 0.7 * len(before)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
