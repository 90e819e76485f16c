"""The event envelope of a feed, as columns and as text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA = "struct<type:string,id:string,seq:bigint,eventTime:bigint>"


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def row_events(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Log rows as `event` envelopes: `(eventType, data, message)`, and the columns in `keep`."""
    data = F.struct("type", "id", "seq", _millis(F.col("event_time")).alias("eventTime"))
    return rows.select(
        *(keep or []),
        F.lit("event").alias("eventType"),
        data.alias("data"),
        F.lit(None).cast("string").alias("message"),
    )


def keepalive_events(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return rows.select(
        *(keep or []),
        F.lit("keepalive").alias("eventType"),
        F.lit(None).cast(DATA).alias("data"),
        F.lit(None).cast("string").alias("message"),
    )


def error_events(rows: DataFrame, message: Column, keep: list[str] | None = None) -> DataFrame:
    """The last event of a stream."""
    return rows.select(
        *(keep or []),
        F.lit("error").alias("eventType"),
        F.lit(None).cast(DATA).alias("data"),
        message.alias("message"),
    )


def deleted_feed_errors(cursor_rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """An error event for each cursor whose feed is gone: `(id, eventType, data, message)`."""
    gone = cursor_rows.select("id").distinct().join(feeds.select("id"), "id", "left_anti")
    return error_events(gone, F.lit("the feed is gone"), ["id"])


def event_line(event_type: Column, data: Column, message: Column) -> Column:
    """One event as JSON text; absent members are left out."""
    return F.to_json(F.struct(event_type.alias("eventType"), data.alias("data"), message.alias("message")))


def event_lines(events: DataFrame) -> DataFrame:
    return events.select(event_line(F.col("eventType"), F.col("data"), F.col("message")).alias("value"))
