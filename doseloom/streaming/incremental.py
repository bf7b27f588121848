"""Streams: each record once, newest per key and counts by event time, from a folder that grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema, **options: str) -> DataFrame:
    """Rows of the parquet files in a folder, and of those that come."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def once_within(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once; state of a key is dropped when the watermark has passed it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, by: str) -> DataFrame:
    """Rows by tumbling window and a column; rows later than the watermark are dropped by Spark and counted in its metrics."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).count().select(F.col("window.start").alias("start"), by, F.col("count").alias("n"))


def sessions(stream: DataFrame, time: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """by, start, end, n of rows that follow each other within a gap; a session is given out when the watermark has passed its end."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).count().select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))


def process_new(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Runs work on every new batch and appends rows whose key is not in the target yet; ends when all that is there is done."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        done = work(batch)
        try:
            done = done.join(spark.read.parquet(target).select(key).distinct(), key, "left_anti")
        except Exception as error:  # the target does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
        done.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
