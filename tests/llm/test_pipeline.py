import corpus_pipeline
from grantlens.llm import suffix_dedup, toxicity

from .cases import documents, empty

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        made = stage(spark, docs, DATA)
        if k < 4:
            assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
            assert made.count() == before if k == 3 else made.count() < before
            docs = made
        else:
            assert made.select("doc_id").distinct().count() == before


def test_one_of_each_group_stays(spark):
    left = corpus_pipeline.near_duplicate_stage(spark, documents(spark), DATA)
    ids = [r.doc_id for r in left.collect()]
    assert 24 in ids and 27 not in ids and ids.count(54) == 1 and None in ids and {0, 3, 6} <= set(ids)


def test_repeated_text_goes(spark):
    docs = documents(spark)
    made = corpus_pipeline.repeated_text_stage(spark, docs, DATA)
    rows = {r.doc_id: r for r in made.collect()}
    assert made.columns == docs.columns and made.count() == docs.count()
    assert rows[24].text == "" and rows[24].n_chars == 0 and rows[0].text is None
    assert len(rows[33].text) < 700 and suffix_dedup.LENGTH == 200


def test_empty(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), DATA).count() == 0
    assert toxicity.THRESHOLD == 0.3
