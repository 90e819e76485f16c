"""Registry, log scans, timing, ordering and validation on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.functions.columns import clamp, clamp_scalar
from tidegraph.functions.events import event_lines, error_events, keepalive_events
from tidegraph.functions.jsontext import parsed
from tidegraph.operators import feeds as fd
from tidegraph.operators import polling as pl
from tidegraph.operators import validate as va
from tidegraph.operators.history import latest_per_key, scan_clustered, scan_history, write_clustered
from tidegraph.operators.ordering import previous_best, running_count, with_sequence
from tidegraph.operators.timing import debounce, heartbeats
from tidegraph.schema import CHANGEFEEDS, HISTORY
from tidegraph.sources.documents import normalise

STAMP = "2024-05-01 08:30:00"


def feed_table(spark, rows):
    df = spark.createDataFrame(rows, "id string, parent_id string, type_filter array<string>, max_ack bigint")
    return df.withColumn("created", F.lit(STAMP).cast("timestamp")).withColumn("last_ack", F.lit(STAMP).cast("timestamp")).select(
        *[f.name for f in CHANGEFEEDS]
    )


def log_table(spark, rows):
    df = spark.createDataFrame(rows, "type string, id string, seq bigint, at bigint")
    return df.select("type", "id", "seq", F.timestamp_seconds("at").alias("event_time"))


# Registry -------------------------------------------------------------------


def test_registry_bounds_and_event_times(spark):
    feeds = feed_table(
        spark, [("root", None, None, 7), ("child", "root", ["a", "b"], 3), ("none", "root", [], 0), ("odd", None, ["zzz"], 0)]
    )
    # The newest row by number is not the newest by time.
    log = log_table(spark, [("a", "1", 10, 500), ("b", "2", 11, 400), ("c", "3", 12, 900)])
    got = {r["id"]: r for r in fd.registry(feeds, log).withColumn("t", F.unix_seconds("max_event_time")).collect()}
    assert {k: r["parent_max_ack"] for k, r in got.items()} == {"root": 12, "child": 7, "none": 7, "odd": 12}
    assert {k: r["t"] for k, r in got.items()} == {"root": None, "child": 400, "none": None, "odd": None}
    empty = spark.createDataFrame([], HISTORY)
    assert {r["parent_max_ack"] for r in fd.registry(feeds.filter("parent_id is null"), empty).collect()} == {0}


@pytest.mark.parametrize("number", [-3, -1, 0, 1, 4, 7])
@pytest.mark.parametrize("size", [-1, 1, 31, 101])
def test_pages_and_links(spark, number, size):
    names = [f"f{i:03d}" for i in range(130)]
    rows = feed_table(spark, [(n, None, None, 0) for n in names])
    at, wide = max(number, 0), min(max(size, 1), 100)
    got = [r["id"] for r in fd.page(rows, number, size).collect()]
    assert got == names[at * wide : (at + 1) * wide]
    links = fd.page_links(number, size, len(got))
    assert (links["self"], links["first"]) == (at, 0)
    assert links["prev"] == (at - 1 if at else None)
    assert links["next"] == (at + 1 if len(got) == wide else None)


def test_descriptions_leave_out_absent_values(spark):
    feeds = feed_table(spark, [("root", None, None, 7), ("child", "root", ["a"], 3)])
    docs = {r["id"]: json.loads(r["document"]) for r in fd.describe(fd.registry(feeds, spark.createDataFrame([], HISTORY))).collect()}
    assert docs["root"] == {
        "type": "changefeed",
        "id": "root",
        "attributes": {"maxAck": 7, "parentMaxAck": 0, "created": "2024-05-01T08:30:00.000Z", "lastAck": "2024-05-01T08:30:00.000Z"},
        "relationships": {},
    }
    assert docs["child"]["relationships"] == {"parent": {"data": {"type": "changefeed", "id": "root"}}}
    assert docs["child"]["attributes"]["typeFilter"] == ["a"] and "maxEventTime" not in docs["child"]["attributes"]


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_acks_are_bounded_and_monotonic(spark, hot_rows):
    feeds = feed_table(spark, [("p", None, None, 100), ("c", "p", None, 50), ("idle", "p", None, 9)])
    registered = fd.registry(feeds, log_table(spark, [("a", "1", 500, 1)]))
    acks = spark.createDataFrame(
        [(0, "c", 101, 10), (1, "c", 60, 11), (2, "c", 60, 12), (3, "c", 1, 13), (4, "nobody", 1, 14), (5, "idle", 9, 15)],
        "ord bigint, id string, ack bigint, at bigint",
    ).withColumn("ts", F.timestamp_seconds("at"))
    checked = fd.check_acks(registered, acks, hot_rows)
    assert {r["ord"]: r["outcome"] for r in checked.collect()} == {
        0: "beyond_parent", 1: "accepted", 2: "accepted", 3: "accepted", 4: "unknown", 5: "accepted",
    }
    after = fd.apply_acks(feeds, checked)
    got = {r["id"]: (r["max_ack"], r["t"]) for r in after.withColumn("t", F.unix_seconds("last_ack")).collect()}
    stamp = 1714552200
    assert got == {"p": (100, stamp), "c": (60, 11), "idle": (9, stamp)}
    assert [tuple(r) for r in fd.ack_progress(feeds, after).collect()] == [("c", 60)]


def test_creating_and_deleting_feeds(spark):
    feeds = feed_table(spark, [("p", None, None, 100), ("c", "p", None, 50)])
    requests = spark.createDataFrame(
        [(0, "n", None, "p"), (1, "n", None, None), (2, "c", None, None), (3, "x", None, "nobody")],
        "ord bigint, id string, type_filter array<string>, parent_id string",
    ).withColumn("ts", F.current_timestamp())
    checked = fd.check_creates(feeds, requests)
    assert {r["ord"]: r["outcome"] for r in checked.collect()} == {0: "created", 1: "duplicate", 2: "duplicate", 3: "unknown_parent"}
    assert {r["id"]: r["max_ack"] for r in fd.create_feeds(feeds, checked).collect()} == {"p": 100, "c": 50, "n": 0}
    gone = fd.check_deletes(feeds, spark.createDataFrame([(0, "p"), (1, "c"), (2, "q"), (3, "c")], "ord bigint, id string"))
    assert [r["outcome"] for r in gone.orderBy("ord").collect()] == ["has_children", "deleted", "unknown", "unknown"]
    assert [r["id"] for r in fd.delete_feeds(feeds, gone).collect()] == ["p"]


def test_requests_are_judged_in_order(spark):
    feeds = feed_table(spark, [("p", None, None, 2), ("c", "p", None, 0), ("d", "c", None, 0)])
    asked = [(0, "x", "nobody"), (1, "x", "p"), (2, "x", "p"), (3, "kid", "late"), (4, "late", "x"), (5, "kid", "late"), (6, "late", "p")]
    requests = spark.createDataFrame([(o, i, None, p) for o, i, p in asked], "ord bigint, id string, type_filter array<string>, parent_id string")
    checked = fd.check_creates(feeds, requests.withColumn("ts", F.current_timestamp())).orderBy("ord").collect()
    assert [r["outcome"] for r in checked] == ["unknown_parent", "created", "duplicate", "unknown_parent", "created", "created", "duplicate"]

    deletes = spark.createDataFrame([(0, "p"), (1, "d"), (2, "c"), (3, "p"), (4, "c")], "ord bigint, id string")
    gone = fd.check_deletes(feeds, deletes).orderBy("ord").collect()
    assert [r["outcome"] for r in gone] == ["has_children", "deleted", "deleted", "deleted", "unknown"]


def test_any_cut_of_acks_gives_the_same_registry(spark):
    feeds = feed_table(spark, [("p", None, None, 2), ("c", "p", None, 0), ("d", "c", None, 0)])
    log = log_table(spark, [("a", "1", 30, 1)])
    rng = random.Random(4)
    acks = [(o, rng.choice("pcdd"), rng.randrange(35), o) for o in range(40)]

    def table(rows):
        return spark.createDataFrame(rows, "ord bigint, id string, ack bigint, at bigint").withColumn("ts", F.timestamp_seconds("at"))

    position, want = {"p": 2, "c": 0, "d": 0}, {}
    for o, i, a, _ in acks:
        bound = {"p": 30, "c": position["p"], "d": position["c"]}[i]
        want[o] = "accepted" if a <= bound else "beyond_parent"
        if a <= bound:
            position[i] = max(position[i], a)
    for cuts in ([40], [7, 40]):
        state, got, start = feeds, {}, 0
        for end in cuts:
            checked = fd.check_acks(fd.registry(state, log), table(acks[start:end])).cache()
            got |= {r["ord"]: r["outcome"] for r in checked.collect()}
            state, start = fd.apply_acks(state, checked), end
        assert got == want and {r["id"]: r["max_ack"] for r in state.collect()} == position


def test_clamps(spark):
    assert [clamp_scalar(v, 1, 10_000) for v in (-100, 5, 2**31 - 1)] == [1, 5, 10_000]
    assert clamp_scalar(-100, 0) == 0
    df = spark.createDataFrame([(-100,), (5,), (2**31 - 1,)], "v bigint").select(clamp(F.col("v"), 1, 10_000).alias("v"))
    assert [r["v"] for r in df.collect()] == [1, 5, 10_000]


# Log ------------------------------------------------------------------------


def test_log_scans(spark, tmp_path):
    log_table(spark, [("Aa"[i % 2], str(i), i, i) for i in range(1, 50)]).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    seqs = lambda *a: [r["seq"] for r in scan_history(log, *a).collect()]
    assert seqs(10, 20, None, 100) == list(range(11, 21))
    assert seqs(10, 20, ["a"], 3) == [11, 13, 15] and seqs(10, 20, ["A"], 2) == [12, 14]
    assert seqs(0, 50, ["A", "a"], 2) == [1, 2] and seqs(0, 50, [], 5) == []
    plan = scan_history(log, 10, 20, ["a"], 3)._jdf.queryExecution().toString()
    assert "GreaterThan(seq,10)" in plan and "EqualTo(type,a)" in plan and "TakeOrderedAndProject" in plan


def test_latest_per_key(spark):
    log = log_table(spark, [("a", "1", 3, 30), ("a", "1", 9, 20), ("a", "2", 4, 1)])
    assert sorted((r["id"], r["seq"]) for r in latest_per_key(log).collect()) == [("1", 9), ("2", 4)]


def test_event_lines_of_other_kinds(spark):
    one = spark.range(1)
    lines = event_lines(keepalive_events(one).unionByName(error_events(one, F.lit("boom"))))
    assert [r[0] for r in lines.collect()] == ['{"eventType":"keepalive"}', '{"eventType":"error","message":"boom"}']


# Ordering -------------------------------------------------------------------


def test_sequence_is_gapless_and_ordered(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), f"{rng.random():.9f}") for _ in range(3000)]
    got = with_sequence(spark.createDataFrame(rows, "k int, id string").repartition(5), ["k", "id"], "n", 100).collect()
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows)
    assert sorted(r["n"] for r in got) == list(range(101, 3101))


def test_running_count_of_a_group_with_most_rows(spark):
    rows = [("big" if i % 10 else "small", i, i % 3 == 0) for i in range(2000)]
    got = running_count(spark.createDataFrame(rows, "g string, o bigint, c boolean"), ["g"], ["o"], F.col("c"), "n").collect()
    seen = {}
    for g, o, c in rows:
        seen[g] = seen.get(g, 0) + c
        rows[o] = (g, o, seen[g])
    assert sorted((r["g"], r["o"], r["n"]) for r in got) == sorted(rows)


@pytest.mark.parametrize("hot_rows", [1_000_000, 7])
def test_previous_best(spark, hot_rows):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.6 else str(rng.randrange(20)), i, rng.randrange(100)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {r["o"]: r["p"] for r in previous_best(df, ["k"], "o", F.col("v"), "p", hot_rows).collect()}
    best, want = {}, {}
    for k, o, v in rows:
        want[o] = best.get(k)
        best[k] = max(v, best.get(k, v))
    assert got == want


# Timing ---------------------------------------------------------------------


def timed(spark, rows):
    return spark.createDataFrame(rows, "k string, at bigint, o bigint, e boolean").withColumn("ts", F.timestamp_seconds("at"))


def test_debounce_boundary_ties_and_eager_rows(spark):
    rows = [("a", 0, 0, False), ("a", 10, 1, False), ("a", 21, 2, False), ("a", 21, 3, False), ("a", 22, 4, True), ("b", 5, 5, False)]
    kept = lambda w, e=None: sorted(r["o"] for r in debounce(timed(spark, rows), ["k"], "ts", "o", w * 1_000_000, e).collect())
    assert kept(10) == [1, 4, 5], "rows exactly a window apart are one burst"
    assert kept(10, F.col("e")) == [1, 3, 4, 5]
    assert kept(0) == [0, 1, 3, 4, 5]


@pytest.mark.parametrize("window", [1, 7, 40])
def test_debounce_equals_brute_force(spark, window):
    rng = random.Random(window)
    rows = [(rng.choice("aaab"), rng.randrange(600), i, False) for i in range(200)]
    got = sorted(r["o"] for r in debounce(timed(spark, rows), ["k"], "ts", "o", window * 1_000_000).collect())
    want = []
    for key in "ab":
        mine = sorted((at, o) for k, at, o, _ in rows if k == key)
        want += [o for (at, o), nxt in zip(mine, [*mine[1:], None]) if nxt is None or nxt[0] - at > window]
    assert got == sorted(want)


def test_heartbeats_fill_gaps(spark):
    beats = lambda ats, t=10: sorted(
        r["at_us"] // 1_000_000 for r in heartbeats(timed(spark, [("a", at, i, False) for i, at in enumerate(ats)]), ["k"], "ts", t * 1_000_000).collect()
    )
    assert beats([0, 5]) == [] and beats([0, 10]) == []
    assert beats([0, 30]) == [10, 20] and beats([0, 35]) == [10, 20, 30]
    assert beats([0, 35, 36, 60]) == [10, 20, 30, 46, 56]
    far = beats([0, 1_000_000])
    assert far == list(range(10, 1_000_000, 10)), "silences longer than a block of buckets"


# Validation -----------------------------------------------------------------

def crate(**members):
    return {"type": "crate", "id": "c7", **members}


OWNER = {"data": {"type": "depot", "id": "d1"}}
DOCUMENTS = [
    (crate(), None),
    (crate(attributes={"weight": 3}, relationships={"owner": OWNER}), None),
    (crate(relationships={"stops": {"data": [{"type": "depot", "id": "d1"}, {"type": "ship", "id": "s2"}]}}), None),
    (crate(relationships={"bare": {}, "null": {"data": None}, "none": {"data": []}}), None),
    (crate(relationships=None, attributes=None, meta={"sequenceNumber": None}), None),
    (crate(meta={"sequenceNumber": 12}), None),
    (crate(attributes={"owner": 1}, relationships={"owner": OWNER}), "shared_name"),
    (crate(relationships={"type": OWNER}), "reserved_name"),
    (crate(attributes={"id": "x"}), "reserved_name"),
    (crate(attributes={"links": "x"}), "nested_member"),
    (crate(attributes={"parts": [{"a": None}, {"b": {"relationships": "x"}}]}), "nested_member"),
    (crate(attributes={"note": 'say {"links": 1} and ,"links":2', "w": "links", "linksx": 1}), None),
    (crate(attributes={'{"links': 1, 'x","links': 2}), None),
    ({"type": "crate"}, "identifier"),
    ({"type": "crate", "id": 7}, "identifier"),
    (crate(relationships={"owner": {"data": {"type": "depot"}}}), "relationship"),
    (crate(relationships={"owner": {"data": "depot"}}), "relationship"),
    (crate(relationships={"owner": {"data": [{"type": "depot", "id": "1"}, {"id": "2"}]}}), "relationship"),
    (crate(relationships={"owner": {"data": {"type": "depot", "id": 9}}}), "relationship"),
    (crate(relationships={"owner": {"data": {"type": "depot", "id": {"k": 1}}}}), "relationship"),
    (crate(relationships="text"), "relationship"),
    (crate(relationships=[OWNER]), "relationship"),
    (crate(relationships={"x": 5}), "relationship"),
    (crate(relationships={"x": 5, "y": {"data": {"type": "depot"}}}), "relationship"),
    (crate(attributes="text"), "attributes"),
    (crate(attributes=[1]), "attributes"),
    (crate(meta={"sequenceNumber": "abc"}), "sequence"),
    (crate(meta={"sequenceNumber": "12"}), "sequence"),
    (crate(meta={"sequenceNumber": 1.7}), "sequence"),
    (["no", "object"], "malformed"),
]


def test_document_rules(spark):
    texts = [json.dumps(d) for d, _ in DOCUMENTS] + ["{not json"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("d", parsed(F.col("t")))
    got = {r["i"]: r["f"] for r in df.select("i", va.document_fault(F.col("d")).alias("f")).collect()}
    assert [got[i] for i in range(len(texts))] == [f for _, f in DOCUMENTS] + ["malformed"]


FEED_DOCUMENTS = [
    ({"type": "changefeed", "id": "x", "attributes": {}}, None),
    ({"type": "changefeed", "id": "x", "attributes": {"typeFilter": ["a", "b"]}}, None),
    ({"type": "changefeed", "id": "x", "attributes": {"typeFilter": []}}, None),
    ({"type": "changefeed", "id": "x", "attributes": {"typeFilter": None}}, None),
    ({"type": "changefeed", "id": "x", "attributes": {"typeFilter": 123}}, "type_filter"),
    ({"type": "changefeed", "id": "x", "attributes": {"typeFilter": "a"}}, "type_filter"),
    ({"type": "changefeed", "id": "x", "attributes": {"typeFilter": ["a", 1]}}, "type_filter"),
    ({"type": "feed", "id": "x", "attributes": {}}, "type"),
    ({"type": "changefeed", "attributes": {}}, "identifier"),
    ({"type": "changefeed", "id": "x", "relationships": {"parent": {"data": {"type": "changefeed", "id": "p"}}}}, None),
    ({"type": "changefeed", "id": "x", "relationships": {"parent": {"data": {"type": "feed", "id": "p"}}}}, "parent_type"),
]


def test_changefeed_rules(spark):
    rows = [(i, json.dumps(d)) for i, (d, _) in enumerate(FEED_DOCUMENTS)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("d", parsed(F.col("t")))
    got = {r["i"]: r["f"] for r in df.select("i", va.changefeed_fault(F.col("d")).alias("f")).collect()}
    assert [got[i] for i in range(len(rows))] == [f for _, f in FEED_DOCUMENTS]


def test_path_must_name_the_document(spark):
    body = json.dumps({"data": {"type": "n", "id": "a"}})
    rows = [(0, "put", "n", "a", body), (1, "put", "n", "b", body), (2, "put", "m", "a", body), (3, "delete", "m", "z", None)]
    raw = spark.createDataFrame(rows, "ord bigint, op string, path_type string, path_id string, body string")
    raw = raw.withColumn("ts", F.current_timestamp()).withColumn("header_seq", F.lit(None).cast("bigint"))
    accepted, rejected = va.split_writes(raw, normalise(raw))
    assert sorted(r["ord"] for r in accepted.collect()) == [0, 3]
    assert sorted((r["ord"], r["reason"]) for r in rejected.collect()) == [(1, "unprocessable"), (2, "unprocessable")]


def test_batch_limits(spark):
    big = spark.range(10_001).select(F.lit(1).alias("batch_id"), F.lit("n").alias("type"), F.col("id").cast("string"))
    full = spark.range(10_000).select(F.lit(2).alias("batch_id"), F.lit("n").alias("type"), F.col("id").cast("string"))
    twice = spark.createDataFrame([(3, "n", "a"), (3, "n", "a"), (4, "n", "a"), (4, "m", "a")], "batch_id int, type string, id string")
    items = big.unionByName(full).unionByName(twice)
    verdicts = va.batch_verdicts(items)
    assert {r["batch_id"]: (r["items"], r["verdict"]) for r in verdicts.collect()} == {
        1: (10_001, "too_large"), 2: (10_000, "ok"), 3: (2, "unprocessable"), 4: (2, "ok"),
    }
    assert {r["batch_id"] for r in va.accepted_items(items, verdicts).select("batch_id").distinct().collect()} == {2, 4}


# Kept-up maxima, waking, clustered log --------------------------------------


def test_maxima_kept_up_over_any_cut_equal_those_of_the_log(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), str(i), i, rng.randrange(1000)) for i in range(1, 60)]
    log = log_table(spark, rows)
    feeds = feed_table(spark, [("root", None, ["a", "c"], 7), ("child", "root", ["b"], 3), ("none", None, None, 0)])
    whole = sorted(map(tuple, fd.registry(feeds, log).collect()), key=lambda r: r[0])
    for bounds in ([0, 59], [0, 1, 30, 59], [0, 20, 20, 59]):
        newest = fd.newest_per_type(log.limit(0))
        for low, high in zip(bounds, bounds[1:]):
            newest = fd.merge_newest(newest, log.filter(F.col("seq").between(low + 1, high)))
        assert sorted(map(tuple, fd.registry_from(feeds, newest).collect()), key=lambda r: r[0]) == whole
    empty = fd.registry_from(feeds, fd.newest_per_type(log.limit(0))).collect()
    assert {(r["id"], r["parent_max_ack"], r["max_event_time"]) for r in empty} == {("root", 0, None), ("child", 7, None), ("none", 0, None)}


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_progress_wakes_children_that_may_read_on(spark, hot_rows):
    feeds = feed_table(
        spark,
        [("root", None, None, 9), ("near", "root", None, 2), ("far", "root", None, 8), ("other", "calm", None, 0), ("leaf", "near", None, 0)],
    )
    progress = spark.createDataFrame([("root", 6), ("root", 8), ("root", 8), ("leaf", 5), ("gone", 3)], "id string, max_ack bigint")
    woken = fd.woken_children(feeds, progress, hot_rows)
    assert [tuple(r) for r in woken.collect()] == [("near", "root", 8)]
    assert fd.woken_children(feeds, progress.limit(0), hot_rows).count() == 0

    log = log_table(spark, [("a", str(i), i, i) for i in range(1, 12)])
    opened = pl.cursors(fd.registry(feeds.withColumn("max_ack", F.when(F.col("id") == "root", 4).otherwise(F.col("max_ack"))), log), F.lit(20))
    raised = fd.wake(opened, woken)
    assert [(r["feed"], r["seq"]) for r in pl.poll(raised, log).orderBy("seq").collect()] == [("near", s) for s in range(3, 9)]
    later = opened.drop("parent_max_ack").withColumn("parent_max_ack", F.lit(8).cast("bigint")).select(*opened.columns)
    assert fd.wake(later, woken).count() == 0


def test_a_clustered_log_opens_only_the_folders_of_a_range(spark, tmp_path):
    log = log_table(spark, [("ab"[i % 2], str(i), i * 7, i) for i in range(1, 2001)])
    path = str(tmp_path / "log")
    write_clustered(log.orderBy(F.rand(1)), path, 1000)
    for low, high, kinds, size in [(0, 14000, None, 9), (6999, 7140, None, 500), (7000, 7000, None, 5), (2000, 3000, ["b"], 40), (-5, 7, [], 5)]:
        want = scan_history(log, low, high, kinds, size).collect()
        assert scan_clustered(spark, path, 1000, low, high, kinds, size).collect() == want
    def opened(rows):
        scan = rows._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
        return scan.selectedPartitions().totalNumberOfFiles()

    whole = len(spark.read.parquet(path).inputFiles())
    assert whole >= 15 and opened(spark.read.parquet(path)) == whole
    assert 1 <= opened(scan_clustered(spark, path, 1000, 7000, 7140, None, 500)) <= 2
