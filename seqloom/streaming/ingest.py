"""Aligning pairs as files arrive: a stateless stream, so every pair is scored once and output is only appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from seqloom.plans.aligner import Aligner

SCHEMA = StructType([StructField("id", LongType()), StructField("a", StringType()), StructField("b", StringType())])


def pair_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of (id, a, b) in a folder, as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def seq_stream(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of .seq files as they come: a record runs from one '>' to the next."""
    from pyspark.sql import functions as F

    rows = spark.readStream.option("lineSep", "\n>").option("pathGlobFilter", "*.seq").text(path)
    both = F.split(F.regexp_replace("value", "^>|\\n$", ""), "\n<", 2)
    return rows.select(both[0].alias("a"), both[1].alias("b")).where("b is not null")


def align_stream(pairs: DataFrame, aligner: Aligner, output: str, checkpoint: str, with_cigar: bool = False) -> StreamingQuery:
    """Writes costs (and edit scripts) to Parquet until all files that are there now are done."""
    found = aligner.align(pairs) if with_cigar else aligner.costs(pairs)
    return found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
