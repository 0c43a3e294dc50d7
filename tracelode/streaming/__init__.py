"""Incremental ingest: thin Structured Streaming wrappers whose result equals the batch operators'. An extension; results are per batch of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import page_columns


def page_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of page rows with their derived columns, from a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path).withColumns(page_columns(F.col("text")))


def run_to_end(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Hand every available micro-batch to ``sink`` (called again with the same number after a failure), then stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def append_pages(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Append new pages to a table; a repeated batch overwrites its own folder, so nothing is written twice."""

    def sink(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_to_end(page_stream(spark, source, schema), checkpoint, sink)


def slice_counts(frames: DataFrame, duration: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Frames a tumbling window of event time for each episode, with late rows up to the watermark."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", duration), "episode_id").agg(F.count(F.lit(1)).alias("n_frames")).select(
        "episode_id", F.col("window.start").alias("start"), "n_frames"
    )
