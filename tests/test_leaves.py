"""Leaves of a condensed graph: nodes without links of their own take no part in its rounds."""

import random

import pytest
from test_condense import LINK, SEED, brute_components, brute_values, components_of, links, values_of

from tidegraph.operators import condense as cd


def test_links_to_leaves_are_not_condensed(spark):
    rows = [("nation", str(k % 3), "customer", str(k)) for k in range(30)] + [("region", "1", "nation", "1"), ("nation", "1", "region", "1")]
    rows += [("customer", str(k % 20), "order", str(k)) for k in range(500)]
    graph = cd.condense(spark.createDataFrame(rows, LINK))
    assert {(r.type, r.id) for r in graph.nodes.collect()} == {(t, i) for t, i, _, _ in rows}
    # Ten customers without an order are leaves as well.
    assert graph.leaves.count() == 510
    named = cd.strong_components(graph).collect()
    assert len(named) == 500 + 30 + 3 + 1
    assert sorted((r.type, r.id) for r in named if r.members > 1) == [("nation", "1"), ("region", "1")]
    seeds = [("nation", "2", 4), ("order", "2", 9), ("order", "0", 3), ("order", "none", 7)]
    got = {(r.type, r.id): r.value for r in cd.spread_condensed(graph, spark.createDataFrame(seeds, SEED)).collect()}
    want = {("nation", "2"): 4} | {("customer", str(k)): 4 for k in range(30) if k % 3 == 2}
    want |= {("order", str(k)): 4 for k in range(500) if k % 20 % 3 == 2} | {("order", "2"): 9, ("order", "0"): 3, ("order", "none"): 7}
    assert got == want


@pytest.mark.parametrize("hot_keys", [100_000, 0])
def test_random_graphs_with_many_leaves(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(cd, "MAX_HOT_KEYS", hot_keys)
    rng = random.Random(7 + hot_keys)
    pairs = [(rng.randrange(40), rng.randrange(120)) for _ in range(150)] + [(3, 3), (90, 90), (5, 90)]
    graph = cd.condense(links(spark, pairs))
    assert components_of(graph) == brute_components(pairs)
    seeds = [(rng.randrange(130), rng.randrange(1_000)) for _ in range(12)]
    assert values_of(spark, graph, seeds) == brute_values(pairs, seeds)
