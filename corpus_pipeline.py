"""Documents to packed training sequences: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import packing, pii, quality, simhash, toxicity
from corpusflow.llm.storage import ready
from corpusflow.session import shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the fixed rules or the compression bands reject (operator 3)."""
    ready(spark)
    return quality.keep_good(docs)


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the Kneser-Ney models of the labelled ones predict as toxic (operator 9)."""
    ready(spark)
    return toxicity.keep_ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of SimHash near-duplicates (operator 7)."""
    ready(spark)
    return simhash.keep_first(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind (operator 4)."""
    ready(spark)
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences (operator 8)."""
    ready(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", good), ("toxicity", ordinary), ("SimHash near-dedup", unique), ("PII", masked), ("packing", packed)]

#: Compression ratios, XXH64 and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
