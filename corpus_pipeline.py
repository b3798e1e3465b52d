"""Corpus pipeline: quality, line dedup, near-dedup, mixing, packing; each stage is a table in and a table out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickledger.llm import line_dedup, mixing, packing, quality, simhash
from brickledger.llm.shared import written

#: Near-duplicates of the third stage: words of a shingle, least Jaccard similarity of the sets of shingles.
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the table `labels`, keeps."""
    model = quality.trained_on_labels(spark, docs, sf_dir)
    return quality.grade_documents(docs, model).where("kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated lines; n_chars follows the text."""
    done = line_dedup.remove_repeated_lines(docs).select("row.*", "kept_text")
    chars = F.coalesce(F.char_length("kept_text"), F.lit(0)).cast("long")
    texts = {"text": F.col("kept_text"), "n_chars": F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(chars)}
    return done.withColumns(texts).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash fingerprints within 3 bits, or at least 0.8 of the five-word
    shingles in common, which fingerprints alone would find for few pairs."""
    return simhash.keep_one_by_either(docs, NEAR_SHINGLE, NEAR_SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents mixed to weights at which no source is cut or passed more than twice; passes repeat rows.

    The rows come in the order of the mix, from partition to partition and inside each.
    """
    # Written first, as ranges are drawn from a sample, for which the mix would be computed twice.
    mixed = written(mixing.mix_sources(docs, repetition_limit=mixing.REPETITION_LIMIT).select("row", "position", "order_key"))
    return mixed.repartitionByRange("position", "order_key").sortWithinPartitions("position", "order_key").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: The first and the third stage can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
