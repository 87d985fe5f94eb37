"""Incremental libraries: a file stream of candidate batches, de-duplicated by key, scored and appended once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def candidate_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_seen(stream: DataFrame, key: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows with a key not seen before: over all time, or within a watermark if a time column bounds the state."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def score_into(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and write it to a folder named by its number, replaced as a whole: a repeated batch changes nothing."""

    def step(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, window: str, *keys: str | Column, delay: str = "10 minutes") -> DataFrame:
    """Rows per window and key, dropping rows later than ``delay``."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))
