"""Incremental ingestion: files that arrive in a folder are added to a catalogue table once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream, with the time of their arrival."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ingested_at", F.current_timestamp())


def keep_ingesting(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to target and stops; started again it goes on where it was."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
