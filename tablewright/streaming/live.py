"""Live twins of the batch roll-ups: file streams of events in, the same tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of the events table as they arrive; the schema is that of the files there."""
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_outcomes(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and type; a window closes once the watermark is past it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def progress(events: DataFrame) -> DataFrame:
    """The batch progress roll-up, kept up to date."""
    return events.groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def append_events(events: DataFrame, out: str, checkpoint: str):
    """Exactly-once append of new events to a ledger folder; ends when all files there have been read."""
    return events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
