"""Counts of substrings that grow with a stream of sequences.

Counts before the frequency filter add up, so each micro-batch appends its own partial counts under its batch number
(a batch that is run again replaces its folder) and the filter is applied when the table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.mining import add_up, nodes


def follow(sequences: DataFrame, folder: str, checkpoint: str, depth: int) -> StreamingQuery:
    """Starts a query that keeps partial counts of a streaming (sample, seq) under folder."""

    def add(batch: DataFrame, number: int) -> None:
        nodes(batch, 1, depth).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sequences.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, fmin: int) -> DataFrame:
    """(sample, path, freq, left_char) of all batches so far."""
    return add_up(spark.read.parquet(folder), fmin)
