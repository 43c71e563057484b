"""The training-corpus pipeline: quality rules, near-duplicate join, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, which has been written as
Parquet and read again. All but the last return the columns of documents; the last returns the packing plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mentionloom.llm.common import shared_dir
from mentionloom.llm.mixing import mixed_documents
from mentionloom.llm.packing import pack_documents
from mentionloom.llm.pii import redacted
from mentionloom.llm.quality import keep_good
from mentionloom.llm.shingles import deduplicated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, position, words."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("pii", personal_data), ("source_mixing", source_mix), ("best_fit_packing", packing)]

#: The classifier, the packing order and the join have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
