"""A training-corpus pipeline: five stages over `documents`, each kept as Parquet.

STAGES lists (name, function). Each function takes the session, the rows its predecessor kept
and the folder of the tables, and returns the rows it keeps; all but the last return the columns
of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import decontamination, line_dedup, near_duplicates, packing, quality_classifier
from tallyweave.llm.common import ready, table
from tallyweave.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose predicted quality reaches the classifier's threshold."""
    return quality_classifier.accept(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later runs of repeated lines and single long ones; documents that lose every line go."""
    ready(spark)
    return line_dedup.clean(docs, alone=line_dedup.LONG_LINE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, similarity 0.8)."""
    ready(spark)
    return near_duplicates.deduplicate(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark item occurs."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their places in the sequences."""
    ready(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("packing", packed),
]

# The classifier's scores cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; each one's rows are written to the shared folder and read again."""
    ready(spark)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
