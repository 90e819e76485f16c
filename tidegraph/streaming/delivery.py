"""Serving feeds: requests and acknowledgements in, events out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegraph.functions.events import deleted_feed_errors, row_events
from tidegraph.lineage import cut
from tidegraph.operators.closure import closure
from tidegraph.operators.edges import edges_of
from tidegraph.operators.feeds import (
    ack_progress,
    apply_acks,
    check_acks,
    check_creates,
    check_deletes,
    create_feeds,
    delete_feeds,
    parent_bounds,
    registry,
    woken_children,
)
from tidegraph.operators.hydrate import hydrate_each
from tidegraph.operators.polling import advance, cursors, poll
from tidegraph.schema import NODE
from tidegraph.streaming.snapshots import SnapshotStore


# Requests of any kind; those of no concern to a kind are NULL.
REQUESTS = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("type_filter", T.ArrayType(T.StringType())),
        T.StructField("ack", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


def found_feeds(spark: SparkSession, root: str, feeds: DataFrame, buckets: int = 64) -> None:
    """Publish a registry to start from, ahead of all request batches."""
    store = SnapshotStore(spark, root, buckets)
    every = list(range(store.width))
    version = store.next_version()
    store.publish(version, {"changefeeds": store.stage("changefeeds", feeds, every, version, ["id"])}, 0)


def process_requests(
    requests: DataFrame, batch_id: int, feeds_root: str, log_root: str, buckets: int = 64, writer: str = ""
) -> None:
    """One micro-batch of feed requests: creates, then acks, then deletes.

    A batch is known by its `writer`, such as the checkpoint folder of a query, and its
    number, so that another query's batches of the same numbers are not taken for replays.
    Appends the outcome of every request, and to `ack_progress` the feeds whose
    position really moved, which is what their children read by.  The outputs
    are written before the registry is published and a replay replaces them.
    """
    spark = requests.sparkSession
    store, log = SnapshotStore(spark, feeds_root, buckets), SnapshotStore(spark, log_root, buckets)
    if store.done(writer, batch_id):
        return
    version = store.next_version()
    requests = cut(requests)
    before = cut(store.read("changefeeds").drop("bucket"))

    created = cut(check_creates(before, requests.filter("kind = 'create'")))
    feeds = cut(create_feeds(before, created))
    acked = cut(check_acks(parent_bounds(feeds, F.lit(log.max_seq())), requests.filter("kind = 'ack'")))
    moved = cut(apply_acks(feeds, acked))
    deleted = cut(check_deletes(moved, requests.filter("kind = 'delete'")))
    after = delete_feeds(moved, deleted)

    outcomes = created.select("ord", "id", F.lit("create").alias("kind"), "outcome")
    outcomes = outcomes.unionByName(acked.select("ord", "id", F.lit("ack").alias("kind"), "outcome"))
    outcomes = outcomes.unionByName(deleted.select("ord", "id", F.lit("delete").alias("kind"), "outcome"))
    store.append("outcomes", outcomes, version)
    store.append("ack_progress", ack_progress(feeds, moved), version)
    touched = store.touched("changefeeds", requests)
    rows = after.filter(store.bucket_of("changefeeds").isin(touched))
    staged = {"changefeeds": store.stage("changefeeds", rows, touched, version, ["id"])}
    store.publish(version, staged, 0, {writer: batch_id})


def start_requests(
    requests: DataFrame, feeds_root: str, log_root: str, checkpoint: str, buckets: int = 64
) -> StreamingQuery:
    return (
        requests.writeStream.foreachBatch(
            lambda batch, batch_id: process_requests(batch, batch_id, feeds_root, log_root, buckets, checkpoint)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def process_progress(progress: DataFrame, batch_id: int, feeds_root: str, buckets: int = 64) -> None:
    """One micro-batch of `ack_progress` rows: the children that they wake go to the output `woken`, `(id, parent_id, bound)`.

    A replay replaces its own rows.  Of the registry only ids, parents and positions are read, and no log.
    """
    store = SnapshotStore(progress.sparkSession, feeds_root, buckets)
    store.append("woken", woken_children(store.read("changefeeds"), progress), batch_id)


def start_waking(spark: SparkSession, feeds_root: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Follow the progress of acks, which `process_requests` appends, and wake children by it."""
    progress = spark.readStream.schema("id string, max_ack bigint").parquet(f"{feeds_root}/ack_progress/*")
    return (
        progress.writeStream.foreachBatch(lambda batch, batch_id: process_progress(batch, batch_id, feeds_root, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def deliver(
    log: SnapshotStore, registered: SnapshotStore, buffer: int, open_cursors: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """What every feed gets from the published log, and its cursor afterwards.

    Without `open_cursors` all feeds start at their acknowledged position, so
    rows delivered but never acknowledged come again.  Children read up to what
    their parent has acknowledged; what a feed has acknowledged since leaves its cursor's
    window.  Events are `(feed, eventType, data,
    message)`; a cursor whose feed was deleted gets one last error.
    """
    feeds = registered.read("changefeeds").drop("bucket")
    history = log.read("history")
    rows = cut(cursors(registry(feeds, history), F.lit(buffer)))
    gone = None
    if open_cursors is not None:
        gone = deleted_feed_errors(open_cursors, feeds).withColumnRenamed("id", "feed")
        bounds = rows.select("id", F.col("parent_max_ack").alias("_bound"), F.col("max_ack").alias("_acked"))
        rows = cut(
            open_cursors.join(bounds, "id")
            .withColumn("parent_max_ack", F.greatest("parent_max_ack", "_bound"))
            .withColumn("max_ack", F.greatest("max_ack", "_acked"))
            .withColumn("inflight", F.filter("inflight", lambda s: s > F.col("max_ack")))
            .select(*open_cursors.columns)
        )
    delivered = cut(poll(rows, history))
    events = row_events(delivered, ["feed"])
    return (events if gone is None else events.unionByName(gone)), advance(rows, delivered)


def hydrated(store: SnapshotStore, delivered: DataFrame) -> DataFrame:
    """The documents of delivered resources `(type, id)`: flat rows as of `hydrate_each`.

    First one shared closure, which reads only the buckets it reaches; then the
    documents within that part of the graph.
    """
    versions = store.versions()
    roots = cut(delivered.select(*NODE).distinct())
    reached = cut(closure(store.links_along_edges(versions), roots))
    buckets = store.touched("resources", reached)
    part = store.read("resources", buckets, versions).join(reached, NODE, "left_semi")
    return hydrate_each(part, edges_of(part), roots)


def debounce_stream(
    rows: DataFrame, keys: list[str], ts: str, order: str, window: str, lateness: str, eager: Column | None = None
) -> DataFrame:
    """Streaming twin of `timing.debounce`; `ts` is TIMESTAMP, `window` an interval such as `250 milliseconds`.

    Rows later than `lateness` are dropped, and a burst is emitted once the
    watermark has passed its end.
    """
    timely = rows.withWatermark(ts, lateness)
    held = timely if eager is None else timely.filter(~F.coalesce(eager, F.lit(False)))
    last = (
        held.groupBy(*keys, F.session_window(ts, window))
        .agg(F.max_by(F.struct(*rows.columns), F.struct(ts, order)).alias("row"))
        .select("row.*")
    )
    return last if eager is None else last.unionByName(timely.filter(F.coalesce(eager, F.lit(False))))
