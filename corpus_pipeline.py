"""The training-data pipeline: STAGES in order, each over all that the stage before it kept.

Each stage carries all columns, whatever their names. Null and empty texts have no words, so the quality
rules reject them. Rows that repeat a doc_id are documents of their own; of rows that repeat doc_id and text
the join of near copies leaves one. Without labels nothing is learned: every document scores 0.5 and only the
base rule rejects. An empty table of documents gives no rows, an empty benchmark rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import decontamination, jaccard_join, packing, quality_classifier, quality_rules
from lexispark.llm.common import Scratch, bound_batches


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    bound_batches(spark)
    return quality_classifier.filter_documents(docs, docs, _labels(spark, sf_dir))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    bound_batches(spark)
    return quality_rules.filter_documents(docs, _labels(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at Jaccard 0.8 of five-word shingles, the one with the smallest doc_id stays."""
    bound_batches(spark)
    return jaccard_join.filter_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bound_batches(spark)
    return decontamination.filter_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in sequences of 2048 tokens."""
    bound_batches(spark)
    return packing.best_fit(docs)


STAGES = [("quality_classifier", classifier), ("quality_rules", rules), ("ngram_jaccard_join", near_copies), ("decontamination", decontaminate), ("best_fit_packing", pack)]

#: Two stages are models, which SQL can't express; tests compare the others with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark, "pipeline") as scratch:
        for i, (name, stage) in enumerate(STAGES):
            last = i == len(STAGES) - 1
            docs = (scratch.keep if last else scratch.table)(stage(spark, docs, sf_dir), f"{i}_{name}")
    return docs
