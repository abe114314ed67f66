"""The training-text pipeline: each stage works on all that its predecessor kept.

1. quality: documents that the classifier scores under its threshold go.
2. near_duplicates: of each group of documents alike (80 per cent or more of
   their five-word shingles, the usual measure of near-duplicates), the one with
   the smallest id stays.
3. decontamination: documents with a verified benchmark window go.  One item is
   enough here, where the query of its own marks two: a passage left in spoils
   the benchmark, a document less costs little.
4. secrets: what the forest takes for a secret is replaced by a mark.
5. tokens: texts are encoded; their token ids, the ids' number and digests of
   ids and decoded text are added to the columns of documents.

Every stage keeps null and empty texts unless its own rule rejects them (the
classifier scores them like any other), rows of repeated or null ids are rows of
their own, and columns it does not know pass through.  Intermediate tables are
deleted when the next stage has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtable.llm import bpe, decontam, neardup, quality, secretscan
from loomtable.llm._shared import dropped_since, mark, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.tokens(docs, public_tokenizers.path(bpe.VOCABULARY), digests=True)


STAGES = [("quality", keep_quality), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("secrets", redact), ("tokens", tokenize)]

#: Neither the fitted models nor merges and links over components can be said in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs, at = table(spark, sf_dir, "documents"), mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            dropped_since(spark, at, docs)
    return docs
