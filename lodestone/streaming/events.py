"""Streams: windowed counts with late data, gap sessions, and idempotent upserts of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import upsert_table


def windowed(events: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their value by window and type; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: a new one after a pause of ``gap``."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def upsert_stream(events: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """A stream whose micro-batches are upserted into a table; a batch that comes again changes nothing."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert_table(df, path, keys, order) and None).trigger(availableNow=True).start()
