from helpers import awkward, empty, truth

import corpus_pipeline
from ledgerloom.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_every_stage_keeps_the_columns_and_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        results.append((name, before, docs))
        if name != "packing":
            assert docs.columns == columns
    (_, raw, mild), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, packed) = results
    model = toxicity.fit(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    assert mild.count() == toxicity.score(raw, model).where("score < 0.5").count()
    ids, texts = zip(*sorted(mild.select("doc_id", "text").collect()), strict=True)
    assert {r[0] for r in single.select("doc_id").collect()} == {ids[i] for i in truth(texts)}
    assert clean.count() == single.count() and clean.where("text rlike '[a-z]@[a-z0-9]+[.]'").count() == 0
    assert mixed.select("doc_id").distinct().count() <= clean.count()
    assert packed.where("start = 0").count() == mixed.count()


def test_stages_survive_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() >= 1, name


def test_stages_of_an_empty_table_are_empty(spark):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
