"""Streaming jobs against their batch forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.operators.closure import reverse_closure
from tidegraph.operators.edges import edges_of
from tidegraph.operators.hydrate import hydrate_each
from tidegraph.operators.timing import debounce
from tidegraph.operators.writes import classify_writes, state_after, write_results
from tidegraph.schema import CHANGEFEEDS
from tidegraph.sources import retail
from tidegraph.sources.documents import normalise, read_writes, stream_writes
from tidegraph.sources.sinks import stream_events, write_events
from tidegraph.functions.events import row_events
from tidegraph.streaming.delivery import (
    REQUESTS,
    debounce_stream,
    deliver,
    found_feeds,
    hydrated,
    process_requests,
    start_requests,
    start_waking,
)
from tidegraph.streaming.propagation import process_writes, start_propagation
from tidegraph.streaming.snapshots import SnapshotStore

SF = "/root/testdata/sf0.001"


def put(ord_, type_, id_, seq, attributes, refs=(), op="put"):
    relationships = {f"r{i}": {"data": {"type": t, "id": k}} for i, (t, k) in enumerate(refs)}
    data = {"type": type_, "id": id_, "attributes": attributes, "relationships": relationships}
    return {
        "ord": ord_,
        "ts": f"2024-01-01T00:00:{ord_ % 60:02d}Z",
        "op": op,
        "path_type": type_,
        "path_id": id_,
        "header_seq": seq,
        "body": json.dumps({"data": data}),
    }


def write_file(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def random_batches(seed, batches=3, size=25):
    rng, ord_ = random.Random(seed), 0
    for _ in range(batches):
        rows = []
        for _ in range(size):
            target = str(rng.randrange(8))
            refs = [("n", str(rng.randrange(8))) for _ in range(rng.randrange(3))]
            op = "delete" if rng.random() < 0.15 else "put"
            rows.append(put(ord_, "n", target, rng.choice([None, ord_, rng.randrange(60)]), {"v": rng.randrange(3)}, refs, op))
            ord_ += 1
        yield rows


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three files of random writes, run through the propagation stream."""
    base = tmp_path_factory.mktemp("propagation")
    for i, rows in enumerate(random_batches(3)):
        write_file(base / "in", f"{i}.json", rows)
    query = start_propagation(
        stream_writes(spark, str(base / "in"), files_per_batch=1),
        str(base / "store"),
        str(base / "checkpoint"),
        interval=None,
        buckets=4,
    )
    query.awaitTermination()
    return base, SnapshotStore(spark, str(base / "store"), 4)


def test_stream_state_equals_one_batch_over_all_writes(spark, stored):
    base, store = stored
    assert store.last_version() == 2
    classified = classify_writes(None, normalise(read_writes(spark, str(base / "in"))))
    whole = state_after(classified)
    columns = ["type", "id", "deleted", "resource", "sequence_number", "created", "updated"]
    key = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert key(store.read("resources")) == key(whole)
    assert rows_of(store.output("results"), "ord", "result") == rows_of(write_results(classified), "ord", "result")


def test_stream_edges_equal_references_of_final_state(stored):
    _, store = stored
    columns = ["from_type", "from_id", "to_type", "to_id"]
    assert rows_of(store.read("edges"), *columns) == rows_of(edges_of(store.read("resources")), *columns)


def test_stream_log_has_one_fresh_number_per_resource(stored):
    _, store = stored
    log = store.read("history")
    assert log.count() == log.select("type", "id").distinct().count() == log.select("seq").distinct().count()
    assert log.agg(F.max("seq")).first()[0] == store.max_seq()
    marks = rows_of(store.high_water_marks(), "version", "max_seq")
    assert [m[1] for m in marks] == sorted({m[1] for m in marks})


def test_replaying_a_batch_changes_nothing(spark, stored):
    base, store = stored
    before = rows_of(store.read("history"), "type", "id", "seq")
    process_writes(read_writes(spark, str(base / "in" / "2.json")), 2, str(base / "store"), 4, str(base / "checkpoint"))
    assert rows_of(store.read("history"), "type", "id", "seq") == before


def test_another_checkpoint_is_another_writer(spark, tmp_path):
    """Batches that start from 0 again under a new checkpoint are no replays; the store keeps its own bucket count."""
    for k, name in enumerate(["a", "b", "c"]):
        write_file(tmp_path / f"in{k}", "0.json", [put(k, "n", name, 1, {"v": 1})])
    root = str(tmp_path / "store")
    for k, (batch, buckets, writer) in enumerate([(0, 4, "first"), (1, 64, "first"), (0, 64, "second"), (0, 4, "second")]):
        process_writes(read_writes(spark, str(tmp_path / f"in{min(k, 2)}")), batch, root, buckets, writer)
    store = SnapshotStore(spark, root)
    assert rows_of(store.read("resources"), "id") == [("a",), ("b",), ("c",)]
    write_file(tmp_path / "again", "0.json", [put(9, "n", "a", 2, {"v": 2})])
    process_writes(read_writes(spark, str(tmp_path / "again")), 1, root, 64, "second")
    assert rows_of(store.output("results").filter("ord = 9"), "result") == [("Updated",)]
    assert store.read("resources").count() == 3


def test_unreadable_lines_are_set_aside(spark, tmp_path):
    """Broken lines change no state, take no other write with them and come out with their file and text."""
    good = [put(0, "n", "a", 1, {"v": 1}), put(1, "n", "b", 1, {"v": 1}), put(2, "n", "a", 2, {}, op="delete")]
    wrong_op, no_place = put(3, "n", "c", 1, {}, op="patch"), put(4, "n", "d", 1, {})
    del no_place["ord"]
    same_place = {**put(1, "n", "e", 1, {}), "op": None}
    broken = ["no json at all", '{"ord":7,', json.dumps(wrong_op), json.dumps(no_place), json.dumps(same_place), "42", '{"ord":"x","op":"put"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join([*broken[:3], "", *map(json.dumps, good), *broken[3:]]) + "\n")
    root = str(tmp_path / "store")
    start_propagation(stream_writes(spark, str(tmp_path / "in")), root, str(tmp_path / "check"), None, 4).awaitTermination()
    store = SnapshotStore(spark, root, 4)
    assert rows_of(store.read("resources"), "type", "id", "deleted") == [("n", "a", True), ("n", "b", False)]
    assert rows_of(store.output("results"), "ord", "result") == [(0, "Created"), (1, "Created"), (2, "Updated")]
    rejected = store.output("rejected").collect()
    details = [json.loads(r.detail) for r in rejected]
    assert len(rejected) == len(broken) and {r.reason for r in rejected} == {"malformed"}
    assert all(d["file"].endswith("in/0.json") for d in details)
    assert {"no json at all", '{"ord":7,', "42", '{"ord":"x","op":"put"}'} <= {d["text"] for d in details}
    assert {json.loads(d["text"]).get("path_id") for d in details if "path_id" in d["text"]} == {"c", "d", "e"}


def test_change_reaches_referrers_only(spark, tmp_path):
    """A change of the parent renumbers its child and grandchild, and nobody else."""
    root = str(tmp_path / "store")
    first = [
        put(0, "n", "parent", 1, {"v": 1}),
        put(1, "n", "child", 1, {"v": 1}, [("n", "parent")]),
        put(2, "n", "grandchild", 1, {"v": 1}, [("n", "child")]),
        put(3, "n", "stranger", 1, {"v": 1}),
    ]
    write_file(tmp_path / "in", "0.json", first)
    write_file(tmp_path / "in", "1.json", [put(4, "n", "parent", 2, {"v": 2})])
    process_writes(read_writes(spark, str(tmp_path / "in" / "0.json")), 0, root, 4)
    store = SnapshotStore(spark, root, 4)
    before = {r["id"]: r["seq"] for r in store.read("history").collect()}
    process_writes(read_writes(spark, str(tmp_path / "in" / "1.json")), 1, root, 4)
    after = {r["id"]: r["seq"] for r in store.read("history").collect()}
    assert {k for k in after if after[k] != before[k]} == {"parent", "child", "grandchild"}
    assert min(after[k] for k in ("parent", "child", "grandchild")) > max(before.values())
    reached = reverse_closure(store.read("edges"), spark.createDataFrame([("n", "parent")], "type string, id string"))
    assert rows_of(reached, "id") == [("child",), ("grandchild",), ("parent",)]


def test_feeds_are_served_acknowledged_and_resumed(spark, stored, tmp_path):
    _, log = stored
    root = str(tmp_path / "feeds")
    stamp = "2024-01-01 00:00:00"
    feeds = spark.createDataFrame(
        [("root", None, None, 0, stamp, stamp), ("child", "root", ["n"], 0, stamp, stamp)],
        "id string, parent_id string, type_filter array<string>, max_ack bigint, created string, last_ack string",
    )
    found_feeds(spark, root, feeds.select(*[F.col(f.name).cast(f.dataType) for f in CHANGEFEEDS]), 4)
    registered = SnapshotStore(spark, root, 4)

    events, cursors = deliver(log, registered, 3)
    seqs = [r["seq"] for r in log.read("history").orderBy("seq").collect()]
    got = {(r["feed"], r["data"]["seq"]) for r in events.collect()}
    assert got == {("root", s) for s in seqs[:3]}, "the child waits for its parent"
    cursors = cursors.cache()

    write_file(tmp_path / "req", "0.json", [
        {"ord": 0, "kind": "ack", "id": "root", "ack": seqs[1], "ts": stamp},
        {"ord": 1, "kind": "ack", "id": "root", "ack": seqs[-1] + 1, "ts": stamp},
        {"ord": 2, "kind": "create", "id": "late", "parent_id": "root", "ts": stamp},
        {"ord": 3, "kind": "create", "id": "lost", "parent_id": "nobody", "ts": stamp},
        {"ord": 4, "kind": "delete", "id": "root"},
    ])
    stream = spark.readStream.schema(REQUESTS).json(str(tmp_path / "req"))
    start_requests(stream, root, log.root, str(tmp_path / "cp"), 4).awaitTermination()
    assert rows_of(registered.output("outcomes"), "id", "kind", "outcome") == [
        ("late", "create", "created"),
        ("lost", "create", "unknown_parent"),
        ("root", "ack", "accepted"),
        ("root", "ack", "beyond_parent"),
        ("root", "delete", "has_children"),
    ]
    assert rows_of(registered.output("ack_progress"), "id", "max_ack") == [("root", seqs[1])]

    for _ in range(2):  # the second run finds no new progress
        start_waking(spark, root, str(tmp_path / "wake"), 4).awaitTermination()
    woken = {tuple(r) for r in registered.output("woken").select("id", "parent_id", "bound").collect()}
    assert woken == {(f, "root", seqs[1]) for f in ("child", "late")}

    events, _ = deliver(log, registered, 3)
    got = {(r["feed"], r["data"]["seq"]) for r in events.collect()}
    assert got == {("root", s) for s in seqs[2:5]} | {(f, s) for f in ("child", "late") for s in seqs[:2]}

    gone = spark.createDataFrame([(1, "delete", "child")], "ord bigint, kind string, id string")
    for f in REQUESTS:
        gone = gone if f.name in gone.columns else gone.withColumn(f.name, F.lit(None).cast(f.dataType))
    process_requests(gone, 1, root, log.root, 4)
    process_requests(gone, 1, root, log.root, 4)
    events, _ = deliver(log, registered, 3, cursors)
    errors = [(r["feed"], r["message"]) for r in events.collect() if r["eventType"] == "error"]
    assert errors == [("child", "the feed is gone")]


def test_hydrated_delivery(spark, stored):
    _, log = stored
    live = log.read("resources").filter("not deleted").select("type", "id")
    resources = log.read("resources").drop("bucket")
    columns = ["root_id", "role", "id", "resource"]
    for roots in (live, live.orderBy("id").limit(1)):
        want = hydrate_each(resources, edges_of(resources), roots)
        assert rows_of(hydrated(log, roots), *columns) == rows_of(want, *columns)


def test_event_lines_are_written_and_streamed(spark, tmp_path):
    rows = spark.createDataFrame(
        [("lamp", "l1", 5, "2024-03-01 00:00:01"), ("desk", "d2", 6, "2024-03-01 00:00:02"), ("lamp", "l3", 9, "2024-03-01 00:00:03")],
        "type string, id string, seq bigint, event_time string",
    ).withColumn("event_time", F.col("event_time").cast("timestamp"))
    # Member names are fixed values of the line format.
    line = '{"eventType":"event","data":{"type":"%s","id":"%s","seq":%d,"eventTime":%d}}'
    start = 1_709_251_200_000
    want = sorted(
        line % (t, i, seq, start + 1000 * k) for t, i, seq, k in [("lamp", "l1", 5, 1), ("desk", "d2", 6, 2), ("lamp", "l3", 9, 3)]
    )
    write_events(row_events(rows), str(tmp_path / "batch"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "batch")).collect()) == want
    rows.write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    stream_events(row_events(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == want


def test_streamed_debounce_equals_batch_for_closed_bursts(spark, tmp_path):
    events = retail.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sentinel = events.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("user_id", F.lit(-1).cast("bigint"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    sentinel.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    eager = F.col("event_type") == "error"
    query = (
        debounce_stream(stream, ["user_id"], "ts", "event_id", "6 hours", "1 day", eager)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    want = debounce(events, ["user_id"], "ts", "event_id", 6 * 3_600_000_000, eager)
    got = spark.read.parquet(str(tmp_path / "out")).filter("user_id >= 0")
    assert rows_of(got, "event_id") == rows_of(want, "event_id")
