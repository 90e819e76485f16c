"""The propagation job: raw writes in, published resources, edges and change log out."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.lineage import cut
from tidegraph.operators.edges import apply_edge_diff, edge_diff
from tidegraph.operators.propagation import compact, propagate
from tidegraph.operators.validate import split_writes
from tidegraph.operators.writes import captured_changes, classify_writes, merge_state, state_after, write_results
from tidegraph.schema import NODE
from tidegraph.sources.documents import normalise
from tidegraph.streaming.snapshots import SnapshotStore


def process_writes(raw: DataFrame, batch_id: int, root: str, buckets: int = 64, writer: str = "") -> None:
    """One micro-batch, known by its `writer` (the checkpoint folder of a query) and its number.

    Only the buckets that hold written, referenced or reached keys are read and
    rewritten, so the cost follows the batch and what it affects, not the store.
    Edges are updated before propagation, as a resource's own new references
    decide what reaches it.  The output `runs` tells of each batch how many changes it claimed and
    how many resources they expanded to; `size_sketches` sums such rows up.
    """
    store = SnapshotStore(raw.sparkSession, root, buckets)
    if store.done(writer, batch_id):
        return
    version = store.next_version()
    raw = cut(raw)
    versions = store.versions()

    accepted, rejected = split_writes(raw, normalise(raw))
    written = store.touched("resources", accepted)
    stored = store.read("resources", written, versions)
    classified = cut(classify_writes(stored.drop("bucket"), accepted))
    after = cut(state_after(classified))
    store.append("results", write_results(classified), version)
    store.append("rejected", rejected, version)
    staged = {
        "resources": store.stage("resources", merge_state(stored.drop("bucket"), after), written, version, NODE)
    }

    diff = cut(edge_diff(stored, after))
    rewired = store.touched("edges", diff)
    new_edges = apply_edge_diff(store.read("edges", rewired, versions).drop("bucket"), diff)
    staged["edges"] = store.stage("edges", new_edges, rewired, version, ["to_type", "to_id"])
    versions["edges"] = {b: v for b, v in {**versions["edges"], **staged["edges"]}.items() if v is not None}

    changes = captured_changes(classified)
    links = store.links_against_edges(versions)
    when = raw.agg(F.max(F.unix_micros("ts"))).first()[0] or 0
    fresh = cut(propagate(changes, links, store.max_seq(), datetime.fromtimestamp(when / 1e6, timezone.utc)))
    reached = store.touched("history", fresh)
    log = compact(store.read("history", reached, versions), fresh)
    staged["history"] = store.stage("history", log, reached, version, ["seq"])

    run = raw.sparkSession.createDataFrame([(changes.count(), fresh.count())], "claimed bigint, expanded bigint")
    store.append("runs", run, version)
    top = fresh.agg(F.max("seq")).first()[0] or store.max_seq()
    store.publish(version, staged, top, {writer: batch_id})


def start_propagation(
    writes: DataFrame, root: str, checkpoint: str, interval: str | None = "500 milliseconds", buckets: int = 64
) -> StreamingQuery:
    """Run `process_writes` over a stream of raw writes; with `interval` None, over what is there now.

    A failed batch is tried again from the checkpoint when the query restarts.
    """
    writer = writes.writeStream.foreachBatch(
        lambda batch, batch_id: process_writes(batch, batch_id, root, buckets, checkpoint)
    ).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start()
