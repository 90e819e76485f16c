"""Debouncing and heartbeats over rows ordered in time.

Both need the next row of the same key.  Cutting time into buckets as wide as
the window makes that local: within a bucket no gap can exceed the window, so
only the last row of a bucket matters, and of the next bucket only the first.
Buckets are aggregates with map-side combine, so a key holding much of the table
is no heavier than the time it spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.columns import micros


def debounce(
    df: DataFrame, keys: list[str], ts: str, order: str, window_us: int, eager: Column | None = None
) -> DataFrame:
    """Per key, the last row of every burst; a burst ends when more than `window_us` pass without a row.

    Rows at the same time are ordered by `order`.  Rows matching `eager` are
    passed through, neither delayed nor taken into account.
    """
    columns = df.columns
    if eager is not None:
        hurried = F.coalesce(eager, F.lit(False))
        return debounce(df.filter(~hurried), keys, ts, order, window_us).unionByName(df.filter(hurried))

    at = micros(F.col(ts))
    latest = F.struct(F.col("_us"), F.col(order))
    if window_us == 0:
        newest = df.withColumn("_us", at).groupBy(*keys, "_us").agg(F.max_by(F.struct(*columns), latest).alias("row"))
        return newest.select("row.*")

    # Each row counts for its own bucket and, by its time only, as the successor
    # of the bucket before: one shuffle brings both together.
    here = F.floor(F.col("_us") / window_us)
    row, us = F.struct(*columns), F.col("_us")
    roles = F.array(
        F.struct(here.alias("bucket"), row.alias("row"), us.alias("us"), F.lit(None).cast("bigint").alias("next_us")),
        F.struct(
            (here - 1).alias("bucket"),
            F.lit(None).cast(df.schema).alias("row"),
            F.lit(None).cast("bigint").alias("us"),
            us.alias("next_us"),
        ),
    )
    buckets = (
        df.withColumn("_us", at)
        .select(*keys, F.explode(roles).alias("r"))
        .groupBy(*keys, "r.bucket")
        .agg(
            F.max_by("r.row", F.when(F.col("r.us").isNotNull(), F.struct("r.us", f"r.row.{order}"))).alias("row"),
            F.max("r.us").alias("us"),
            F.min("r.next_us").alias("next_us"),
        )
    )
    quiet = F.col("us").isNotNull() & (F.col("next_us").isNull() | (F.col("next_us") - F.col("us") > window_us))
    return buckets.filter(quiet).select("row.*")


def heartbeats(df: DataFrame, keys: list[str], ts: str, timeout_us: int) -> DataFrame:
    """Keepalives that fill the silences of each key: `(keys, at_us)`, microseconds since the epoch.

    One every `timeout_us` after a row, strictly before the next row; none after
    the last row.
    """
    bucket = F.floor(F.col("_us") / timeout_us)
    # 4,096 buckets to a block keep the last window, over blocks, small for any key.
    block = F.floor(F.col("bucket") / 4096)
    spans = (
        df.select(*keys, micros(F.col(ts)).alias("_us"))
        .groupBy(*keys, bucket.alias("bucket"))
        .agg(F.min("_us").alias("first"), F.max("_us").alias("last"))
        .withColumn("block", block)
    )
    in_block = Window.partitionBy(*keys, "block").orderBy("bucket")
    blocks = spans.groupBy(*keys, "block").agg(F.min("first").alias("first"))
    after = blocks.select(*keys, "block", F.lead("first").over(Window.partitionBy(*keys).orderBy("block")).alias("later"))
    gaps = (
        spans.withColumn("next", F.lead("first").over(in_block))
        .join(after, [*keys, "block"])
        .select(*keys, "last", F.coalesce("next", "later").alias("next"))
    )
    beats = F.expr(f"(next - last - 1) div {timeout_us}")
    hops = gaps.withColumn("n", beats).filter("n > 0")
    # Two steps, so that no array holds more than 10,000 entries however long the silence.
    chunked = hops.withColumn("chunk", F.explode(F.expr("sequence(0, (n - 1) div 10000)")))
    step = F.expr("sequence(chunk * 10000 + 1, least(n, (chunk + 1) * 10000))")
    return chunked.withColumn("i", F.explode(step)).select(
        *keys, (F.col("last") + F.col("i") * timeout_us).alias("at_us")
    )
