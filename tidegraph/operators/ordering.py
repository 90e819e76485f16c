"""Ordered numbering and running values without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.lineage import cut
from tidegraph.skew import HOT_ROWS, key_load

PARTITION_BITS = 33


def with_sequence(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Number the rows `start + 1, start + 2, ...` in order; rows that tie are numbered in any order.

    The rows are range-partitioned and sorted, and each is numbered within its
    partition.  A last, arbitrary sort key lets a run of ties, too, be split
    over several ranges.  Sampled range bounds may differ between runs, so the result is
    cut before the partition sizes (one row per partition) are summed up.
    """
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order)
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ranged = cut(ranged)
    place = F.shiftright("_at", PARTITION_BITS)
    sizes = ranged.groupBy(place.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_at").bitwiseAND((1 << PARTITION_BITS) - 1)
    return (
        ranged.withColumn("_part", place)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.lit(start) + F.col("_offset") + within + 1)
        .drop("_part", "_at", "_offset")
    )


def running_count(df: DataFrame, group: list[str], order: list[str], counted: Column, name: str) -> DataFrame:
    """Per group, how many `counted` rows there are up to and including each row.

    A group may hold any share of the table: it is cut into the ranges of a
    range partitioning, counted per range, and the counts of earlier ranges are
    added.
    """
    ranged = cut(
        df.withColumn("_counted", counted.cast("bigint"))
        .repartitionByRange(*group, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    totals = ranged.groupBy(*group, "_part").agg(F.sum("_counted").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    upto = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, [*group, "_part"])
        .withColumn(name, F.col("_offset") + F.sum("_counted").over(upto))
        .drop("_part", "_counted", "_offset")
    )


def previous_best(
    df: DataFrame, keys: list[str], order: str, best: Column, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per key, the largest `best` among the rows before each row in `order`.

    `order` is a BIGINT, unique within a key.  Ordinary keys take one window
    over one shuffle.  A key above `hot_rows` is cut into slices of `hot_rows`
    positions; each slice starts from the best of the slices before it.
    """
    df = df.withColumn("_best", best)
    hot = key_load(df, keys, hot_rows).hot
    if hot is None:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.max("_best").over(before)).drop("_best")

    hot = cut(hot).withColumn("_hot", F.lit(True))
    sliced = df.join(F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.when(F.col("_hot"), F.floor(F.col(order) / hot_rows)).otherwise(F.lit(0))
    )
    tops = sliced.filter("_hot").groupBy(*keys, "_slice").agg(F.max("_best").alias("_top"))
    slices_before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "_slice", F.max("_top").over(slices_before).alias("_carried"))
    before = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_local", F.max("_best").over(before))
        .join(carried, [*keys, "_slice"], "left")
        .withColumn(name, F.greatest("_local", "_carried"))
        .drop("_best", "_hot", "_slice", "_local", "_carried")
    )
