"""The corpus pipeline: five stages from raw documents to packed sequences. Part of subpackage seqloom.llm.

Each stage reads what the one before it wrote. The first four return the columns of documents; the last one returns
pieces of documents with their places in sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontamination, packing, quality_classifier, simhash, suffix_dedup
from seqloom.llm.common import shared_dir, table

STAGES = [
    ("quality classifier", quality_classifier.stage),
    ("SimHash near-dedup", simhash.near_copy_stage),
    ("suffix-array dedup", suffix_dedup.stage),
    ("benchmark decontamination", decontamination.stage),
    ("packing", packing.stage),
]

#: Learned scores and byte-pair encoding have no SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
