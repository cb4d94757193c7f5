"""Queries over the driver's tables: one for each operator of this subpackage, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, embeddings, language, licenses, likelihood, mixing, pii, quality, simhash, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.components_of(_table(spark, folder, "embeddings"))


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents"))


def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", "held_out", F.col("lang_best").alias("lang_pred"), F.col("confidence").alias("score"), (F.col("lang") == language.UNKNOWN).alias("rejected"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """score is the model that training documents give; under the vocabulary's own scores it is vocabulary_score."""
    found = likelihood.score(_table(spark, folder, "documents"))
    return found.withColumnsRenamed({"score": "vocabulary_score", "learned_score": "score"})


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.tag(docs, toxicity.fit(docs, _table(spark, folder, "labels")))


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = quality.rate(docs, quality.fit(docs, _table(spark, folder, "labels")))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": embedding_near_dedup,
        "op2_personal_data": personal_data,
        "op3_source_mixing": source_mixing,
        "op4_language_id": language_id,
        "op5_decontamination": decontamination,
        "op6_lm_scoring": lm_scoring,
        "op7_license_scan": license_scan,
        "op8_simhash_near_dedup": simhash_near_dedup,
        "op9_toxic_spans": toxic_spans,
        "op10_quality_classifier": quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": embeddings.SQL, "op3_source_mixing": mixing.SQL, "op5_decontamination": decontaminate.SQL, "op7_license_scan": licenses.sql()}
