"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next.

run(spark, sf_dir) keeps its stages' tables in a folder of its own under the shared one (spark.checkpoint.dir).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from offerlane.llm import decontaminate, exact, near, packing, quality
from offerlane.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with or without id: the one that stays."""
    return exact.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, with or without id: the smallest id. Texts link at a Jaccard similarity of
    their five-word shingles of 0.8 or more."""
    return near.without_near_copies(docs, words=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark stands."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifier, SimHash and packing can't be said in it. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
