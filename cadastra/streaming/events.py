"""Windowed counts of event streams; the batch forms give the same rows on finished tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events and their value by window and type. With ``late`` the table is a stream, whose windows
    close when the watermark has passed them; later events are dropped then."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        df = df.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = df.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Each user's runs of events with no pause of ``gap``."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        df = df.withWatermark("ts", late)
    out = df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream; the schema is that of what lies there."""
    fields = spark.read.parquet(folder).schema
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", per_trigger).parquet(folder)
