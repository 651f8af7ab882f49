"""Corpus pipeline: five operators in a row, each stage's rows written and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracksmith.llm import bpe, common, decontaminate, langid, quality, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; profiles are learnt from the stage's own input."""
    return langid.keep(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of the stage's own input, predicts good."""
    return quality.keep(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.keep(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("quality", good), ("near_duplicates", one_of_each), ("decontamination", decontaminated), ("tokens", tokens)]

#: A classifier's training, connected components and BPE merges can't be said in SQL here; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared checkpoint folder and read again.

    A stage's folder is deleted once the next one's is whole; the last one's stays, as the result reads it.
    """
    folder = common.folder(spark).rstrip("/")
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return docs
