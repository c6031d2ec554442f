"""The queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, mixing, ngram_join, packing, quality, sharding, substring_dedup, topk, toxicity
from .common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_by_document(documents(spark, sf_dir), least_words=substring_dedup.PASSAGE)


def op2_segment_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(documents(spark, sf_dir), words_each=3, percent=90).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    )


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(documents(spark, sf_dir), n_shards=8)


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op6_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_copies(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op8_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op9_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_sequences(documents(spark, sf_dir))


def op10_line_chain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_segment_bound_topk": op2_segment_bound_topk,
    "op3_count_vector_join": op3_count_vector_join,
    "op4_byte_shards": op4_byte_shards,
    "op5_counterfactual_toxicity": op5_counterfactual_toxicity,
    "op6_diagonal_licenses": op6_diagonal_licenses,
    "op7_systematic_mix": op7_systematic_mix,
    "op8_byte_convolution": op8_byte_convolution,
    "op9_certified_packing": op9_certified_packing,
    "op10_line_chain_quality": op10_line_chain_quality,
}
