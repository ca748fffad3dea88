"""From raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept;
its result is written as Parquet and read again as the next one's documents. All but the
last return the columns of documents; mixing repeats a document's row as often as it is
taken, and the last returns a row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import exact_dedup, mixing, near_dup, packing, quality
from sylva.llm.common import id_remainder, shared_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored under 0.3; learns from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    voters = quality.fit(docs, labels.filter(id_remainder("doc_id", 5) != 0))
    scored = quality.classify(docs, voters)
    return scored.filter(F.col(scored.columns[-1]) == 1).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.keep_one(docs, exact_dedup.new_index(docs))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 150 % of all words by weight, none over two epochs."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_dedup_stage), ("near_dup", near_dup_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
