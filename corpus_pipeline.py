"""The corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrobora.llm import line_dedup, near_dedup, packing, quality_classifier, quality_rules
from corrobora.llm.common import load
from corrobora.llm.encoding import vocabulary_path
from corrobora.session import pin


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accept(docs, load(spark, sf_dir, "labels"))


def rule(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.accept(docs, load(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line matches."""
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rule),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("packing", pack),
]

#: The models and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = pin(docs, name.replace(" ", "-"))
    return docs
