"""A corpus pipeline out of the package's operators: each stage reads what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidegraph.lineage import shared_folder
from tidegraph.llm import minhash, mixing, secrets, sentencepieces, toxicity
from tidegraph.llm.base import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores as toxic go."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (a Jaccard of 0.8) the document with the least id stays."""
    return minhash.without_copies(docs, percent=minhash.LOOSE)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to equal shares; a document comes as often as it was drawn."""
    return mixing.mix(docs).select(*docs.columns)


def sentencepieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids with their N best segmentations; the ids decode to the very texts."""
    return sentencepieces.encode(docs, sentencepieces.Vocabulary.load(sentencepieces.default_model()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash", minhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("sentencepieces", sentencepieces_stage),
]
ORACLE_SQL = None  # learned scores, hashed signatures and segmentations are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for step, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{step}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
