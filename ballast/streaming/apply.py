"""Fitted transforms on a stream.

A fitted model is a set of literals or a small static table, so its ``transform`` is a projection or
a stream-static join.  Operators that rank or count the whole table refuse streaming input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def apply_models(stream: DataFrame, *models) -> DataFrame:
    """Apply fitted transforms one after the other."""
    for m in models:
        stream = m.transform(stream)
    return stream


def read_parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the schema of the files already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append it to a parquet table and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
                 .outputMode("append").trigger(availableNow=True).start()
