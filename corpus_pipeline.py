"""The corpus pipeline: five operators in turn over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's result as Parquet into the shared folder and
reads it again, so a lost executor never costs more than the running stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near_dedup, packing, pii, quality, toxicity
from tessera.llm.common import prepare
from tessera.llm.queries import tokenizer_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (score of 0.7 or more) go."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model, output="_score").where("_score < 0.7").select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go."""
    model = quality.fit(docs, _labels(spark, sf_dir))
    return quality.score(docs, model, output="_score").where("_score >= 0.3").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    prepare(spark)
    return near_dedup.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Marks take the place of personal data; n_chars follows the text."""
    prepare(spark)
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and place there."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack),
]

#: SQL can't say what trained classifiers decide, so the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
