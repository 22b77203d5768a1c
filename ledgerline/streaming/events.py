"""Hourly counts and failure bursts over an unbounded event log.

Same figures as the batch queries, kept up to date: rows later than the watermark are ignored,
and closed windows leave the state, so the state is bounded by users × open windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_event_time(events: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", late)


def hourly_counts(events: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events and cancelled events per hour."""
    hours = with_event_time(events, time, late).groupBy(F.window("event_time", "1 hour").alias("w"))
    return hours.agg(
        F.count("*").alias("orders"), F.count_if(F.col("event_type") == "error").alias("canceled_orders")
    ).select(F.col("w.start").alias("hour"), "orders", "canceled_orders")


def failure_bursts(events: DataFrame, at_least: int, gap: str = "1 hour", time: str = "ts") -> DataFrame:
    """Users with many failures in one session; a session ends with a pause of ``gap``."""
    failed = with_event_time(events, time).filter(F.col("event_type") == "error")
    windows = failed.groupBy("user_id", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("failures"))
    return windows.filter(F.col("failures") >= at_least).select(
        "user_id", F.col("w.start").alias("window_start"), "failures"
    )


def write_stream(df: DataFrame, folder: str, name: str, progress: str) -> StreamingQuery:
    """Append closed windows as Parquet.

    ``progress`` is a lasting shared folder of the caller's; a later run that is given the same one goes
    on where this one stopped.
    """
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/{name}")
        .option("checkpointLocation", f"{progress}/{name}")
        .trigger(availableNow=True)
        .start()
    )
