"""The corpus operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from latentspark.llm import (
    centroid_clustering, embedding_dedup, license_scan, packing, pii, quality_classifier, quality_rules, secrets, sentencepiece_codec, simhash, token_store, url_filter, vector_codes,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_read(spark, sf_dir, "embeddings"), cosine=0.98)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty ledger: a blob's findings of another run are not at hand."""
    return secrets.find(_read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_and_check(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=4, radius=4)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024.0)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find(_read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(_read(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0, salt="1")


_QUERIES = (
    op1_embedding_dedup, op2_pii, op3_packing, op4_token_store, op5_url_filter,
    op6_quality_classifier, op7_secrets, op8_sentencepiece, op9_quality_rules, op10_simhash,
    op11_vector_codes, op12_license_scan, op13_centroid_clustering,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it: exact links, URL verdicts and rule statistics. Learned spans, token ids, XXH64 and fitted models are tested against brute force instead."""
    return {
        "op1_embedding_dedup": embedding_dedup.oracle(),
        "op5_url_filter": url_filter.oracle(),
        "op9_quality_rules": quality_rules.oracle(),
        "op11_vector_codes": vector_codes.oracle(),
        "op12_license_scan": license_scan.oracle(),
        "op13_centroid_clustering": centroid_clustering.oracle(),
    }
