"""Reading the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.columns import between_acks, type_matches


def scan_history(
    history: DataFrame, from_ack: int, to_ack: int, type_filter: list[str] | None, size: int
) -> DataFrame:
    """The oldest `size` rows in `(from_ack, to_ack]` whose type passes the filter.

    Both predicates reach the file scan, which skips the row groups that lie outside.
    """
    wanted = between_acks(F.col("seq"), F.lit(from_ack), F.lit(to_ack)) & type_matches(F.col("type"), type_filter)
    return history.filter(wanted).orderBy("seq").limit(size)


def latest_per_key(log: DataFrame) -> DataFrame:
    """An uncompacted log reduced to the newest row of each resource."""
    return log.groupBy("type", "id").agg(
        F.max("seq").alias("seq"), F.max_by("event_time", "seq").alias("event_time")
    )


def write_clustered(history: DataFrame, path: str, width: int) -> None:
    """A copy of the log in folders of `width` sequence numbers, sorted by number within each.

    Rows are dealt out by sampled ranges of numbers, so a folder has a file or two however the numbers lie, and
    no task writes more than its share.
    """
    (
        history.withColumn("seq_range", F.floor(F.col("seq") / width))
        .repartitionByRange("seq")
        .sortWithinPartitions("seq")
        .write.partitionBy("seq_range")
        .parquet(path)
    )


def scan_clustered(
    spark: SparkSession, path: str, width: int, from_ack: int, to_ack: int, type_filter: list[str] | None, size: int
) -> DataFrame:
    """`scan_history` on such a copy; folders outside `(from_ack, to_ack]` are not opened."""
    columns = "type string, id string, seq bigint, event_time timestamp, seq_range bigint"
    log = spark.read.schema(columns).parquet(path)
    held = log.filter(F.col("seq_range").between((from_ack + 1) // width, to_ack // width)).drop("seq_range")
    return scan_history(held, from_ack, to_ack, type_filter, size)
