"""Structured Streaming: hourly counts of an event stream with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TARGET, TIMESTAMP


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files under a folder as a stream; the schema is that of the files now there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_stream(events: DataFrame, late: str = "2 hours", time: str = "ts", series: list[str] = ()) -> DataFrame:
    """Counts by clock hour; an hour is final once the watermark has passed its end, later events are dropped."""
    timed = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", "1 hour"), *series).agg(F.count(F.lit(1)).alias(TARGET))
    return counted.select(*series, F.col("window.start").alias(TIMESTAMP), TARGET)


def into_table(hours: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Final hours into a Parquet table, exactly once; ``once`` ends with what is there."""
    writer = hours.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()
