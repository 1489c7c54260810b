"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, images, kneser_ney, licenses, mixing, preferences, sharding, simhash, tokens, toxicity
from .common import table

N_SHARDS = 40


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.digest(preferences.preferences(table(spark, sf_dir, "conversations")))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), N_SHARDS)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.copies(images.images_from_vectors(table(spark, sf_dir, "embeddings")))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preferences": op1_preferences,
    "op2_shards": op2_shards,
    "op3_simhash": op3_simhash,
    "op4_licenses": op4_licenses,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_image_copies": op7_image_copies,
    "op8_tokens": op8_tokens,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}
ORACLE: dict[str, str] = {
    "op1_preferences": preferences.oracle(),
    "op4_licenses": licenses.oracle(),
    "op5_decontamination": decontam.oracle(),
    "op6_mixing": mixing.oracle(),
}
