"""Bounded streams: a folder of files read to its end, joined with static tables.

Each file batch goes through the same DataFrame operators as a whole table;
the stream ends when everything that is there has been processed, so the
result equals that of the batch query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def read_bounded(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A streaming frame over a folder of Parquet files with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_bounded(stream: DataFrame, build: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> DataFrame:
    """Process everything, write it to ``output`` exactly once, and return the table."""
    query = build(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    query.awaitTermination()
    return stream.sparkSession.read.parquet(output)
