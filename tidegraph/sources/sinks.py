"""Writers for event streams, hydrated documents and feed descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidegraph.functions.events import event_lines
from tidegraph.operators.feeds import describe
from tidegraph.operators.hydrate import documents


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Events as newline-delimited JSON."""
    event_lines(events).write.mode(mode).text(path)


def stream_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        event_lines(events)
        .writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_documents(hydrated: DataFrame, path: str) -> None:
    """Hydrated rows as one JSON document per root."""
    documents(hydrated).select("document").write.mode("overwrite").text(path)


def write_descriptions(registered: DataFrame, path: str) -> None:
    describe(registered).select("document").write.mode("overwrite").text(path)
