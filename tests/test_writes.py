"""Sequenced writes against a fold over one write at a time."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegraph.functions.jsontext import canonical, member, parsed, relationship_ids
from tidegraph.operators import writes as wr
from tidegraph.schema import RAW_BATCHES, RAW_WRITES
from tidegraph.sources.documents import explode_batches, normalise, read_batches, read_writes


def raw_row(ord_, id_, seq, content, op="put", path=None):
    body = {"data": {"type": "n", "id": id_, "attributes": {"v": content}}}
    return (ord_, None, op, "n", path or id_, seq, json.dumps(body))


def writes_table(spark, rows):
    raw = spark.createDataFrame(rows, RAW_WRITES)
    return normalise(raw.withColumn("ts", F.timestamp_seconds(F.col("ord") + 1000)))


def fold(rows):
    """One write at a time, as the upsert guard reads."""
    state, results, changed = {}, {}, {}
    for ord_, _, op, _, key, seq, body in rows:
        deleted = op == "delete"
        content = None if deleted else json.loads(body)["data"]["attributes"]["v"]
        old = state.get(key)
        if old is None:
            result, change, moved = "Created", True, True
        else:
            same = (old["deleted"], old["content"], old["seq"]) == (deleted, content, seq)
            newer = old["seq"] is None or (seq is not None and old["seq"] < seq)
            if not newer and not same:
                results[ord_], changed[ord_] = "OutOfSequence", False
                continue
            result, moved = ("NotModified", False) if same else ("Updated", True)
            change = (old["deleted"], old["content"]) != (deleted, content)
        state[key] = {
            "deleted": deleted,
            "content": content,
            "seq": seq,
            "created": old["created"] if old else ord_ + 1000,
            "updated": ord_ + 1000 if moved else old["updated"],
        }
        results[ord_], changed[ord_] = result, change
    return state, results, changed


def compare(spark, rows, hot_rows):
    state, results, changed = fold(rows)
    classified = wr.classify_writes(None, writes_table(spark, rows), hot_rows).cache()
    assert {r["ord"]: r["result"] for r in wr.write_results(classified).collect()} == results
    assert {r["key"] for r in wr.captured_changes(classified).collect()} == {o for o, c in changed.items() if c}
    got = {
        r["id"]: {
            "deleted": r["deleted"],
            "content": json.loads(r["resource"]).get("attributes", {}).get("v"),
            "seq": r["sequence_number"],
            "created": r["c"],
            "updated": r["u"],
        }
        for r in wr.state_after(classified)
        .select("*", F.unix_seconds("created").alias("c"), F.unix_seconds("updated").alias("u"))
        .collect()
    }
    assert got == state


def random_writes(rng, n, keys):
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else str(rng.randrange(keys))
        seq = rng.choice([None, rng.randrange(12), rng.randrange(12), i // 20])
        rows.append(raw_row(i, key, seq, rng.randrange(3), "delete" if rng.random() < 0.1 else "put"))
    return rows


@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
def test_writes_equal_a_fold_with_a_hot_key(spark, hot_rows):
    compare(spark, random_writes(random.Random(11), 1500, 60), hot_rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_writes_equal_a_fold_on_any_seed(spark, seed):
    compare(spark, random_writes(random.Random(seed), 120, 6), 10)


# stored sequence, incoming sequence, same content, result
CASES = [
    (None, None, False, "Updated"),
    (None, 4, False, "Updated"),
    (None, None, True, "NotModified"),
    (None, 4, True, "Updated"),
    (5, None, False, "OutOfSequence"),
    (5, None, True, "OutOfSequence"),
    (5, 6, False, "Updated"),
    (5, 6, True, "Updated"),
    (5, 5, True, "NotModified"),
    (5, 5, False, "OutOfSequence"),
    (5, 4, True, "OutOfSequence"),
]


def test_result_table(spark):
    rows = []
    for i, (stored, incoming, same, _) in enumerate(CASES):
        rows += [raw_row(2 * i, f"k{i}", stored, 1), raw_row(2 * i + 1, f"k{i}", incoming, 1 if same else 2)]
    got = {r["ord"]: r["result"] for r in wr.write_results(wr.classify_writes(None, writes_table(spark, rows))).collect()}
    assert [got[2 * i + 1] for i in range(len(CASES))] == [c[3] for c in CASES]
    assert {got[2 * i] for i in range(len(CASES))} == {"Created"}


def test_applying_in_two_batches_equals_one(spark):
    rows = random_writes(random.Random(3), 200, 10)
    first = wr.state_after(wr.classify_writes(None, writes_table(spark, rows[:90])))
    second = wr.classify_writes(first, writes_table(spark, rows[90:]))
    both = wr.merge_state(first, wr.state_after(second))
    whole = wr.state_after(wr.classify_writes(None, writes_table(spark, rows)))
    assert sorted(map(repr, both.select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))


def test_deleting_an_unknown_key_leaves_a_tombstone(spark):
    state = wr.state_after(wr.classify_writes(None, writes_table(spark, [raw_row(0, "x", 3, 1, "delete")]))).first()
    assert state["deleted"] and state["out_refs"] == []
    assert json.loads(state["resource"]) == {"type": "n", "id": "x", "meta": {"sequenceNumber": 3}}


def test_conflicts_are_reported_by_position(spark):
    results = spark.createDataFrame(
        [(1, i, "crate", f"c{i}", "OutOfSequence" if i in (0, 4) else "Created") for i in range(7)],
        "batch_id bigint, pos bigint, type string, id string, result string",
    )
    report = sorted(map(tuple, wr.conflict_report(results).select("pointer", "detail").collect()))
    assert report == [("/data(0)", '{"type":"crate","id":"c0"}'), ("/data(4)", '{"type":"crate","id":"c4"}')]
    tally = wr.result_tally(results, ["batch_id"]).first()
    assert (tally["Created"], tally["OutOfSequence"], tally["conflict"]) == (5, 2, True)


def test_ids_may_hold_any_character(spark, tmp_path):
    ids = ["a\u2028b", "c\u0085d", 'q"\\', "n\nl", "🙂"]
    lines = [
        {"ord": k, "op": "put", "path_type": "n", "path_id": i, "body": json.dumps({"data": {"type": "n", "id": i, "meta": {"sequenceNumber": 1.7}}})}
        for k, i in enumerate(ids)
    ]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, lines)))
    rows = normalise(read_writes(spark, str(tmp_path))).orderBy("ord").collect()
    assert [json.loads(r["body"])["id"] for r in rows] == ids and {r["seq"] for r in rows} == {None}


def test_header_sequence_overrides_the_body(spark, tmp_path):
    body = json.dumps({"data": {"type": "n", "id": "a", "meta": {"sequenceNumber": 7}}})
    lines = [
        {"ord": 0, "op": "put", "path_type": "n", "path_id": "a", "body": body},
        {"ord": 1, "op": "put", "path_type": "n", "path_id": "a", "header_seq": 9, "body": body},
    ]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, lines)))
    rows = normalise(read_writes(spark, str(tmp_path))).orderBy("ord").collect()
    assert [r["seq"] for r in rows] == [7, 9]
    assert [json.loads(r["body"])["meta"]["sequenceNumber"] for r in rows] == [7, 9]


def test_batches_keep_positions_and_item_sequences(spark, tmp_path):
    items = [{"type": "n", "id": "a", "meta": {"sequenceNumber": 31}}, {"type": "n", "id": "b", "meta": {"sequenceNumber": 8}}, {"type": "n", "id": "c"}]
    (tmp_path / "b.json").write_text(json.dumps({"batch_id": 1, "body": json.dumps({"data": items})}))
    assert read_batches(spark, str(tmp_path)).schema == RAW_BATCHES
    rows = normalise(explode_batches(read_batches(spark, str(tmp_path)))).orderBy("pos").collect()
    assert [(r["pos"], r["id"], r["seq"]) for r in rows] == [(0, "a", 31), (1, "b", 8), (2, "c", None)]


def test_canonical_text_and_members(spark):
    docs = spark.createDataFrame(
        [('{ "b": 1.0, "a": {"z": null, "y": [1, 2]} }',), ('{"a":{"y":[1,2],"z":null},"b":1}',), ('{"a": null}',), ("{oops",)], "t string"
    ).select(parsed(F.col("t")).alias("d"))
    rows = docs.select(canonical(F.col("d")), member(F.col("d"), "a")).collect()
    assert rows[0] == rows[1] and rows[0][1] == '{"y":[1,2],"z":null}'
    assert rows[2][1] == "null" and rows[3] == (None, None)


def test_relationship_ids_are_distinct_and_sorted(spark):
    text = json.dumps(
        {
            "stops": {"data": [{"type": "depot", "id": "9"}, {"type": "depot", "id": "10"}, {"type": "ship", "id": "1"}]},
            "owner": {"data": {"type": "depot", "id": "9"}},
            "odd": 5,
            "wrong": {"data": [{"type": "depot", "id": 9}, {"type": "depot", "id": {"k": 1}}, "x"]},
            "none": {"links": {"self": "x"}},
            "empty": {"data": []},
            "null": {"data": None},
        }
    )
    df = spark.createDataFrame([(text,), (None,)], "t string").select(relationship_ids(F.col("t")).alias("ids"))
    rows = [[tuple(i) for i in r["ids"]] for r in df.collect()]
    assert rows == [[("depot", "10"), ("depot", "9"), ("ship", "1")], []]
