from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_dedup, pii, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, SF).checkpoint()
        assert kept.columns == docs.columns
        if name == "toxicity":
            assert kept.join(labels.where("toxic = 0"), "doc_id").count() == before.join(labels.where("toxic = 0"), "doc_id").count()
            assert kept.join(labels.where("toxic = 1"), "doc_id").count() < 10
        if name == "quality":
            known = before.join(labels, "doc_id")
            assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * known.where("quality = 1").count()
            assert kept.join(labels.where("quality = 0"), "doc_id").count() <= 0.05 * known.where("quality = 0").count()
        if name == "near_dedup":
            classes = near_dedup.classes(before)
            assert kept.count() == classes.select("class_id").distinct().count()
            assert kept.groupBy("text").count().where("count > 1").count() == 0
        if name == "pii":
            texts = [r.text for r in kept.collect()]
            assert len(texts) == before.count()
            assert all(not pii.base_spans(t) for t in texts)
            assert kept.where(F.col("n_chars") != F.length("text")).count() == 0
    pieces = corpus_pipeline.pack(spark, kept, SF)
    assert pieces.select("doc_id").distinct().count() == kept.count()
    assert pieces.groupBy("doc_id").agg((F.sum("length") - F.max("doc_tokens")).alias("d")).where("d <> 0").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert {"doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"} == set(out.columns)


def test_classifiers_are_the_stages_own(spark):
    assert corpus_pipeline.toxicity is toxicity
    assert corpus_pipeline.quality is quality
