"""Documents to packed sequences: quality classifier, quality rules, near-copy removal, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.llm import boosting, jaccard, packing, rules
from veilgauge.session import materialise

TOKENIZER = "word_bpe_49k.json"


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the held-out fifth, doesn't reject."""
    return boosting.keep_predicted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the quality rules' thresholds of their language and source."""
    return rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of 4096 tokens."""
    pieces = packing.tokenized(docs, public_tokenizers.path(TOKENIZER))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("near copies", drop_near_copies),
    ("packing", pack_sequences),
]

#: SQL can't express a trained classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs, _ = materialise(stage(spark, docs, sf_dir))
    return docs
