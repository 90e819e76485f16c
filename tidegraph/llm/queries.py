"""One registered query per operator of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import (
    divergence,
    hilbert,
    language,
    minhash,
    mixing,
    pivots,
    secrets,
    sentencepieces,
    sharding,
    tileranking,
    tokencount,
    toxicity,
    warc,
)
from tidegraph.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]


def _sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepieces.Vocabulary.load(sentencepieces.default_model())
    return sentencepieces.encode(table(spark, sf_dir, "documents"), vocabulary)


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", mixed["_copy"].alias("copy"), mixed["_place"].alias("place"))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.learn(documents, table(spark, sf_dir, "labels")))


def _sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def _minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=minhash.PERCENT)


def _pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def _hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "n_requests", "n_metadata"]
    return warc.round_trip(table(spark, sf_dir, "pages")).select(*told)


def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.learn(documents))


def _tileranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tileranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.prove(tokencount.default_model()))


def _divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def registered_queries() -> dict[str, Query]:
    return {
        "op1_sentencepieces": _sentencepieces,
        "op2_secrets": _secrets,
        "op3_mixing": _mixing,
        "op4_hilbert": _hilbert,
        "op5_warc": _warc,
        "op6_language": _language,
        "op7_pivots": _pivots,
        "op8_minhash": _minhash,
        "op9_toxicity": _toxicity,
        "op10_sharding": _sharding,
        "op11_tileranking": _tileranking,
        "op12_tokencount": _tokencount,
        "op13_divergence": _divergence,
    }
