"""Corpus pipeline: STAGES applied in order to ``documents``, each stage written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from retention.llm import decontaminate, packing, quality, simhash, toxicity
from retention.llm.common import read
from retention.session import ensure_checkpoint_dir


def _model(spark: SparkSession, sf_dir: str, operator):
    """Trained on the labelled documents as they were, also those that an earlier stage has since rejected."""
    return operator.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay if the compression classifier, trained on the labelled ones, scores them 0.3 or more."""
    return quality.keep_good(docs, _model(spark, sf_dir, quality))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay if the network, trained on the labelled ones, scores them below 0.3."""
    return toxicity.keep_clean(docs, _model(spark, sf_dir, toxicity))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    return simhash.keep_first(docs, "doc_id", "text", words=4, max_bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay if no passage of theirs aligns with a benchmark item."""
    return decontaminate.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"), whole=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence, and the place in it, of every piece of every document that is left."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("toxicity", toxicity_filter),
          ("simhash_near_dedup", simhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination),
          ("best_fit_packing", best_fit_packing)]

#: the stages score and compare texts, which SQL cannot express; tests/llm checks them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages the documents are a table in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
