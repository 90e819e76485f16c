"""The search per root: what it stores and moves, and its rows against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import closure as cl
from tidegraph.operators.hydrate import hydrate_each, hydrate_keys

LINK = "src_type string, src_id string, dst_type string, dst_id string"
NODE = "type string, id string"


def brute(pairs, roots, allowed):
    follow = {}
    for a, b in pairs:
        if b in allowed:
            follow.setdefault(a, set()).add(b)
    out = set()
    for root in roots:
        todo, met = [root], set()
        while todo:
            fresh = follow.get(todo.pop(), set()) - met
            met |= fresh
            todo += fresh
        out |= {(*root, *node) for node in met}
    return out


@pytest.mark.parametrize("hot_keys", [100_000, 0])
def test_random_graphs_with_types_that_come_back(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(cl, "MAX_HOT_KEYS", hot_keys)
    rng = random.Random(hot_keys)
    nodes = [(t, str(k)) for t in "abc" for k in range(60)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(200)] * 2 + [(n, ("gone", "1")) for n in nodes]
    roots, allowed = rng.sample(nodes, 130) + [("none", "1")], set(rng.sample(nodes, 150))
    links = spark.createDataFrame([(*a, *b) for a, b in pairs], LINK)
    got = cl.closure_each(links, spark.createDataFrame(roots, NODE), spark.createDataFrame(sorted(allowed), NODE)).collect()
    assert len(got) == len(set(got))
    assert set(map(tuple, got)) == brute(pairs, roots, allowed)


def test_links_of_types_that_are_never_reached_are_not_stored(spark, monkeypatch):
    stored, settled = [], cl.settled

    def kept(df):
        held = settled(df)
        if {"type", "id", "dst_type", "dst_id"} == set(held.columns):
            stored.append(held.select("type").distinct().collect())
        return held

    monkeypatch.setattr(cl, "settled", kept)
    rows = [("order", str(k), "customer", str(k % 7)) for k in range(500)] + [("customer", str(k), "nation", "1") for k in range(7)]
    rows += [("nation", "1", "region", "1"), ("region", "1", "nation", "1")]
    roots = spark.range(500).select(F.lit("order").alias("type"), F.col("id").cast("string").alias("id"))
    assert cl.closure_each(spark.createDataFrame(rows, LINK), roots).count() == 1_500
    assert {row[0] for types in stored for row in types} == {"customer", "nation", "region"}


def test_keys_alone_are_those_of_the_documents(spark):
    resources = spark.createDataFrame(
        [("n", str(k), k == 3, f"body {k}") for k in range(6)], "type string, id string, deleted boolean, resource string"
    )
    edges = spark.createDataFrame(
        [("n", a, "n", b) for a, b in ["01", "12", "20", "23", "34", "45", "59"]],
        "from_type string, from_id string, to_type string, to_id string",
    )
    roots = spark.createDataFrame([("n", "0"), ("n", "3"), ("n", "4")], NODE)
    keys = sorted(hydrate_keys(resources, edges, roots).collect())
    assert keys == sorted(hydrate_each(resources, edges, roots).drop("resource").collect())
    assert [(r.root_id, r.role, r.id) for r in keys if r.root_id == "4"] == [("4", "data", "4"), ("4", "included", "5")]
