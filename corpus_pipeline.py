"""The corpus pipeline: five stages over ``documents``, each a call of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import langid, mixing, ngram_join, packing, substring_dedup
from pixelloom.llm.common import heap_given_back, passing, pinned


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letters, or in no language that could be learned, go.

    Written here, as is the dedup's result, so that whole rows pass the workers in small batches.
    """
    heap_given_back(spark)
    return pinned(langid.recognised(docs))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: word 5-grams, Jaccard of 0.8 or more."""
    heap_given_back(spark)
    return ngram_join.one_of_each(docs, words_each=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that other documents hold as well stay in one of them."""
    heap_given_back(spark)
    return pinned(substring_dedup.without_repeats(docs, least_words=substring_dedup.PASSAGE))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until each source has its share of words."""
    heap_given_back(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix in sequences of at most 4096."""
    heap_given_back(spark)
    return packing.best_fit_sequences(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Stages train a network and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Stages read their input more than once, so it is written; each table goes when the next is there.
    with passing(spark):
        with passing(spark):
            docs = join_near_copies(spark, identify_language(spark, docs, sf_dir), sf_dir)
            docs = pinned(docs, lasting=True)
        docs = mix_sources(spark, cut_repeated_passages(spark, docs, sf_dir), sf_dir)
        docs = pinned(docs, lasting=True)
    return pack_sequences(spark, docs, sf_dir)
