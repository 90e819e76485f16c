"""Closures, hydration and edges against brute force on small graphs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import closure as cl
from tidegraph.operators.edges import apply_edge_diff, edge_diff, edges_of, incoming, incoming_documents
from tidegraph.operators.hydrate import documents, hydrate_each, hydrate_many, list_document, lookup
from tidegraph.operators.propagation import compact, expansion_per_claim, propagate, size_percentiles, size_sketches

EDGE = "from_type string, from_id string, to_type string, to_id string"
NODE = "type string, id string"


def edge_table(spark, pairs):
    return spark.createDataFrame([("n", str(a), "n", str(b)) for a, b in pairs], EDGE)


def node_table(spark, ids):
    return spark.createDataFrame([("n", str(i)) for i in ids], NODE)


def resource_table(spark, ids, deleted=()):
    rows = [("n", str(i), i in deleted, f'{{"id":"{i}"}}') for i in ids]
    return spark.createDataFrame(rows, "type string, id string, deleted boolean, resource string")


def reach(pairs, seeds, include=True):
    """Ids reachable against the pairs (from, to)."""
    found, todo = set(seeds) if include else set(), list(seeds)
    while todo:
        here = todo.pop()
        for a, b in pairs:
            if b == here and a not in found:
                found.add(a)
                todo.append(a)
    return found


def ids(df):
    return {int(r["id"]) for r in df.collect()}


@pytest.mark.parametrize(
    "pairs, seeds",
    [
        ([(1, 0), (2, 1), (3, 2)], [0]),  # chain
        ([(1, 0), (2, 0), (3, 1), (3, 2)], [0]),  # diamond
        ([(1, 0), (0, 1), (2, 1)], [0]),  # two-cycle
        ([(0, 0), (1, 0)], [0]),  # self-loop
        ([(1, 0)], [7]),  # unknown seed
    ],
)
def test_reverse_closure_shapes(spark, pairs, seeds):
    got = cl.reverse_closure(edge_table(spark, pairs), node_table(spark, seeds))
    assert ids(got) == reach(pairs, seeds)


@pytest.mark.parametrize("hot_degree", [1_000_000, 4])
def test_reverse_closure_on_random_graphs_with_a_hub(spark, hot_degree):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(i, 3) for i in range(30, 60)]
    seeds = [1, 2, 3]
    adj = cl.adjacency(cl.against_edges(edge_table(spark, pairs)), hot_degree=hot_degree)
    assert (adj.hot is not None) == (hot_degree == 4)
    got = cl.closure(adj, node_table(spark, seeds))
    assert ids(got) == reach(pairs, seeds) and got.count() == len(reach(pairs, seeds))


@pytest.mark.parametrize("hot_degree", [1_000_000, 4])
def test_spread_keeps_the_largest_value(spark, hot_degree):
    rng = random.Random(8)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(i, 3) for i in range(20, 30)]
    values = {i: rng.randrange(1000) for i in range(0, 40, 3)}
    want = {}
    for seed, value in values.items():
        for node in reach(pairs, [seed]):
            want[node] = max(want.get(node, -1), value)
    seeds = spark.createDataFrame([("n", str(k), v) for k, v in values.items()], NODE + ", value bigint")
    adj = cl.adjacency(cl.against_edges(edge_table(spark, pairs)), hot_degree=hot_degree)
    assert {int(r["id"]): r["value"] for r in cl.spread(adj, seeds).collect()} == want


def test_links_stored_in_buckets_give_the_same_closure(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(50)]
    bucket = F.pmod(F.xxhash64("type", "id"), F.lit(4)).cast("int")
    links = cl.against_edges(edge_table(spark, pairs))
    stored = links.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), *cl.DST).withColumn("bucket", bucket)
    got = cl.closure(cl.TableLinks(stored, bucket), node_table(spark, [0, 1]))
    assert ids(got) == reach(pairs, [0, 1])


def test_max_relevant_seq_includes_the_resource_itself(spark):
    seqs = spark.createDataFrame([("n", "0", 9), ("n", "1", 5), ("n", "2", 7)], NODE + ", seq bigint")
    got = cl.max_relevant_seq(seqs, edge_table(spark, [(1, 0), (2, 1), (0, 2), (3, 1)]))
    assert {r["id"]: r["max_seq"] for r in got.collect()} == {"0": 9, "1": 9, "2": 9, "3": 9}


def test_hydration_skips_dangling_and_deleted_and_includes_a_cyclic_root(spark):
    # 0 -> 1 -> 0 is a cycle; 1 -> 2 (deleted) -> 3; 1 -> 9 dangles; 0 -> 4.
    edges = edge_table(spark, [(0, 1), (1, 0), (1, 2), (2, 3), (1, 9), (0, 4)])
    resources = resource_table(spark, range(5), deleted={2})
    rows = hydrate_many(resources, edges, node_table(spark, [0]))
    assert sorted((r["role"], r["id"]) for r in rows.collect()) == [
        ("data", "0"),
        ("included", "0"),
        ("included", "1"),
        ("included", "4"),
    ]
    assert hydrate_many(resources, edges, node_table(spark, [2, 77])).count() == 0


def test_hydrate_many_shares_and_hydrate_each_does_not(spark):
    edges = edge_table(spark, [(0, 1), (1, 2)])
    resources = resource_table(spark, range(3))
    roots = node_table(spark, [0, 1, 8])
    shared = sorted((r["role"], r["id"]) for r in hydrate_many(resources, edges, roots).collect())
    assert shared == [("data", "0"), ("data", "1"), ("included", "1"), ("included", "2")]
    each = sorted((r["root_id"], r["role"], r["id"]) for r in hydrate_each(resources, edges, roots).collect())
    assert each == [("0", "data", "0"), ("0", "included", "1"), ("0", "included", "2"), ("1", "data", "1"), ("1", "included", "2")]


def test_a_root_has_one_document_of_any_size(spark):
    edges = edge_table(spark, [(0, i) for i in range(1, 1501)])
    resources = resource_table(spark, range(1501))
    rows = documents(hydrate_each(resources, edges, node_table(spark, [0, 1])))
    shape = "data struct<id:string>, included array<struct<id:string>>"
    found = {r["root_id"]: r["d"] for r in rows.select("root_id", F.from_json("document", shape).alias("d")).collect()}
    assert all(d["data"]["id"] == root for root, d in found.items())
    assert [i["id"] for i in found["0"]["included"]] == sorted(map(str, range(1, 1501))) and found["1"]["included"] == []
    whole = list_document(hydrate_many(resources, edges, node_table(spark, [0, 1, 9999]))).first()["document"]
    assert [len(json.loads(whole)[k]) for k in ("data", "included")] == [2, 1500]
    none = list_document(hydrate_many(resources, edges, node_table(spark, [9999]))).first()["document"]
    assert json.loads(none) == {"data": [], "included": []}


def test_incoming_needs_a_live_target_and_live_referrers(spark):
    edges = spark.createDataFrame(
        [("a", "1", "n", "0"), ("a", "2", "n", "0"), ("b", "3", "n", "0"), ("a", "1", "n", "5"), ("a", "1", "n", "9")], EDGE
    )
    resources = spark.createDataFrame(
        [("a", "1", False, "{}"), ("a", "2", True, "{}"), ("b", "3", False, "{}"), ("n", "0", False, "{}"), ("n", "5", True, "{}")],
        "type string, id string, deleted boolean, resource string",
    )
    bare = incoming_documents(resources, edges, node_table(spark, [0, 5, 9]), "b").select("role", "type", "id")
    assert sorted(map(tuple, bare.collect())) == [("data", "n", "0"), ("included", "b", "3")]
    bare = incoming_documents(resources, edges, node_table(spark, [0]), "z").select("role", "type", "id")
    assert sorted(map(tuple, bare.collect())) == [("data", "n", "0")]
    got = incoming(resources, edges, node_table(spark, [0, 5, 9]), "a")
    assert [(r["to_id"], r["from_id"]) for r in got.collect()] == [("0", "1")]
    assert lookup(resources, node_table(spark, [0, 5, 9])).count() == 1


def test_edge_diff_and_upkeep(spark):
    refs = "array<struct<type:string,id:string>>"
    before = spark.createDataFrame([("n", "0", [("n", "1"), ("n", "2")]), ("n", "7", [("n", "1")])], f"type string, id string, out_refs {refs}")
    after = spark.createDataFrame([("n", "0", [("n", "2"), ("n", "3")]), ("n", "4", [("n", "0")])], f"type string, id string, out_refs {refs}")
    diff = edge_diff(before, after)
    assert sorted((r["from_id"], r["to_id"], r["op"]) for r in diff.collect()) == [
        ("0", "1", "delete"),
        ("0", "3", "insert"),
        ("4", "0", "insert"),
    ]
    kept = apply_edge_diff(edges_of(before), diff)
    assert sorted((r["from_id"], r["to_id"]) for r in kept.collect()) == [("0", "2"), ("0", "3"), ("4", "0"), ("7", "1")]


def test_propagation_orders_by_last_key_and_compaction_keeps_the_newest(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    changes = spark.createDataFrame([(5, "n", "0"), (6, "n", "2"), (9, "n", "0")], "key bigint, type string, id string")
    fresh = propagate(changes, edge_table(spark, [(1, 0), (3, 2), (1, 2)]), 100, at)
    assert {r["id"]: r["seq"] for r in fresh.collect()} == {"2": 101, "3": 102, "0": 103, "1": 104}
    old = spark.createDataFrame([("n", "0", 7, at), ("n", "8", 8, at)], "type string, id string, seq bigint, event_time timestamp")
    assert {r["id"]: r["seq"] for r in compact(old, fresh).collect()} == {"2": 101, "3": 102, "0": 103, "1": 104, "8": 8}


def test_claims_expand_on_their_own(spark):
    rng = random.Random(8)
    pairs = [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(50)]
    queued = [(k, "n", str(rng.randrange(45))) for k in range(300)]  # some in no edge, some several times, over 64 claims
    got = {
        r["claim"]: (r["claimed"], r["expanded"])
        for r in expansion_per_claim(spark.createDataFrame(queued, "key bigint, type string, id string"), edge_table(spark, pairs), 4).collect()
    }
    want = {}
    for c in range(75):
        held = {i for _, _, i in queued[4 * c : 4 * c + 4]}
        reached, todo = set(held), list(held)
        while todo:
            at = todo.pop()
            fresh = {a for a, b in pairs if b == at} - reached
            reached |= fresh
            todo += fresh
        want[c] = (len(held), len(reached))
    assert got == want


def test_merged_sketches_give_percentiles_within_their_error(spark):
    rng = random.Random(9)
    sizes = [int(rng.lognormvariate(5, 2)) for _ in range(20_000)]
    runs = spark.createDataFrame([(n % 10, s) for n, s in enumerate(sizes)], "day int, expanded bigint")
    shares = [0.0, 0.5, 0.9, 0.99, 1.0]
    got = {r["share"]: r["value"] for r in size_percentiles(size_sketches(runs, "expanded", "day"), shares).collect()}
    ordered = sorted(sizes)
    for share in shares:
        low, high = (ordered[min(max(int((share + e) * len(sizes)), 0), len(sizes) - 1)] for e in (-0.025, 0.025))
        assert low <= got[share] <= high
    assert (got[0.0], got[1.0]) == (ordered[0], ordered[-1])
    few = runs.limit(5)
    assert {r["value"] for r in size_percentiles(size_sketches(few, "expanded", "day"), [0.5]).collect()} == {sorted(sizes[:5])[2]}
    assert size_percentiles(size_sketches(runs.limit(0), "expanded", "day"), shares).count() == 0
