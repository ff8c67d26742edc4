"""The corpus pipeline (part of the training-data operators): five stages from raw documents to packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import mixing, near_duplicates, packing, pii, quality_classifier, queries
from attestra.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality_classifier.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality_classifier.quality_column(docs, model)["quality"] >= 0.5)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_duplicates.drop_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the new text."""
    replaced = pii.pseudonymised(docs, queries.pii_key(spark)).select(*docs.columns)
    return replaced.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else replaced


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the sources to temperature weights; a document occurs as often as it is drawn."""
    return mixing.mixed(docs, mixing.word_count(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicate), ("personal data", personal_data), ("source mixture", mixture), ("packing", packed)]

#: SQL can express neither the trained classifier nor tokenisation; tests/llm holds the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to documents, each writing its rows in the shared folder for the next to read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
