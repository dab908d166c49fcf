"""Training corpus from raw documents, stage by stage; each stage's rows are written and read again.

Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.decontaminate import drop_contaminated
from shelfwise.llm.host_rules import drop_bad_documents
from shelfwise.llm.ngram_join import drop_near_duplicates
from shelfwise.llm.packing import pack_documents
from shelfwise.llm.pii import redact_pii
from shelfwise.llm.text import table
from shelfwise.scale import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the base rules, or their host's limits, go."""
    return drop_bad_documents(docs, host="source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard 0.8 links stays: the smallest doc_id."""
    return drop_near_duplicates(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, give or take one edit in 16 characters, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by marks."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts, packed into sequences of 2048 tokens."""
    return pack_documents(docs, length=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: Edit matching, the span classifier and packing are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
