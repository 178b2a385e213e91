"""Corpus pipeline: quality rules, near-duplicate removal, benchmark
decontamination, PII sanitisation and tokenisation, each stage written as
Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontam, ngram_join, pieces, pii, rules
from pagewright.llm.common import ready, scratch_table, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ready(spark)
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least id."""
    ready(spark)
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is generalised, disclosing terms are removed."""
    return pii.sanitise(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids."""
    ready(spark)
    return pieces.tokenize(docs)


STAGES = [("quality_rules", quality_stage), ("ngram_jaccard_join", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("pii", pii_stage), ("sentencepiece", token_stage)]

#: The isolation forest, the Bayesian join, the seeds and the tokenizer have
#: no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch_table(docs, f"pipeline-{name}")
    return docs
