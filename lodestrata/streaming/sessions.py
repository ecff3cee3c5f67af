"""Log and session operators for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.views import severity

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def sessions(events: DataFrame, gap: str = "15 minutes") -> DataFrame:
    """Sessions of a user: events without a gap between them. Streams need a watermark on ts."""
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.select("user_id", "first_ts", "last_ts", "n")


def stream_sessions(spark: SparkSession, folder: str, delay: str = "10 minutes", gap: str = "15 minutes") -> DataFrame:
    """Sessions of a growing folder of event files; a session comes out when the watermark has passed its end."""
    events = spark.readStream.schema(EVENTS).parquet(folder)
    return sessions(events.withWatermark("ts", delay), gap)


def idle(events: DataFrame, minutes: int = 15) -> DataFrame:
    """Users whose last event is at least so long before the latest of all."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    now = last.agg(F.max("last_ts").alias("now"))
    return last.crossJoin(F.broadcast(now)).where(F.col("now") - F.col("last_ts") >= F.expr(f"interval {minutes} minutes")).select("user_id", "last_ts")


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of new files of a folder with their severity."""
    lines = spark.readStream.text(folder)
    return lines.select(F.col("value").alias("line"), severity(F.col("value")).alias("severity"))
