"""Components, levels and closures on the condensed graph against brute force."""

import random

from pyspark.sql import functions as F

from tidegraph.operators import condense as cd

LINK = "src_type string, src_id string, dst_type string, dst_id string"
SEED = "type string, id string, value long"


def links(spark, pairs):
    return spark.createDataFrame([("n", str(a), "n", str(b)) for a, b in pairs], LINK)


def reach(pairs, start):
    out, todo = {start}, [start]
    follow = {}
    for a, b in pairs:
        follow.setdefault(a, set()).add(b)
    while todo:
        for b in follow.get(todo.pop(), ()):
            if b not in out:
                out.add(b)
                todo.append(b)
    return out


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    reached = {x: reach(pairs, x) for x in nodes}
    return {x: min((y for y in reached[x] if x in reached[y]), key=str) for x in nodes}


def brute_values(pairs, seeds):
    out = {}
    for node, value in seeds:
        for x in reach(pairs, node):
            out[x] = max(value, out.get(x, value))
    return out


def components_of(graph):
    return {int(r.id): int(r.component_id) for r in cd.strong_components(graph).collect()}


def values_of(spark, graph, seeds):
    rows = cd.spread_condensed(graph, spark.createDataFrame([("n", str(n), v) for n, v in seeds], SEED)).collect()
    got = {int(r.id): r.value for r in rows}
    assert len(got) == len(rows)
    return got


SHAPES = {
    "chain": [(k, k + 1) for k in range(9)],
    "cycle": [(k, (k + 1) % 7) for k in range(7)],
    "two-cycle": [(1, 2), (2, 1)],
    "cycle with tail and entry": [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5)],
    "two cycles over a run": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (6, 5)],
    "run within a cycle": [(1, 2), (2, 3), (3, 4), (4, 1), (1, 4), (4, 2)],
    "cycles sharing a node": [(1, 2), (2, 1), (1, 3), (3, 4), (4, 1)],
    "parallel runs": [(0, 1), (1, 2), (2, 9), (0, 3), (3, 4), (4, 9), (0, 9)],
    "comb": [(k, k + 1) for k in range(5)] + [(k, 100 + k) for k in range(5)],
    "loops and repeats": [(1, 1), (1, 2), (1, 2), (2, 2), (3, 3)],
    "dense": [(a, b) for a in range(6) for b in range(6)] + [(5, 10), (10, 11), (10, 12), (11, 12)],
}


def test_shapes_side_by_side(spark):
    pairs = [(1_000 * k + a, 1_000 * k + b) for k, shape in enumerate(SHAPES.values(), 1) for a, b in shape]
    graph = cd.condense(links(spark, pairs))
    assert components_of(graph) == brute_components(pairs)
    seeds = []
    for k, shape in enumerate(SHAPES.values(), 1):
        seeds += [(1_000 * k + shape[0][0], 5), (1_000 * k + shape[-1][0], 9), (1_000 * k + shape[len(shape) // 2][1], 7)]
    seeds += [(777, 1), (777, 3)]
    assert values_of(spark, graph, seeds) == brute_values(pairs, seeds)


def random_pairs(rng, n, m):
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return pairs + [(n + k, n + k + 1) for k in range(10)] + [(rng.randrange(n), n), (n + 10, rng.randrange(n))]


def test_random_graphs(spark):
    rng = random.Random(1)
    pairs = [(1_000 * k + a, 1_000 * k + b) for k in range(12) for a, b in random_pairs(rng, 40, 40 + 5 * k)]
    graph = cd.condense(links(spark, pairs))
    assert components_of(graph) == brute_components(pairs)
    assert graph.links.filter("dst_level <= level").count() == 0
    seeds = [(1_000 * rng.randrange(12) + rng.randrange(50), rng.randrange(100)) for _ in range(40)]
    assert values_of(spark, graph, seeds) == brute_values(pairs, seeds)


def test_a_long_chain_takes_few_rounds(spark):
    pairs = [(k, k + 1) for k in range(2_000)]
    graph = cd.condense(links(spark, pairs))
    assert graph.levels == 2 and graph.rounds <= 40
    assert values_of(spark, graph, [(500, 3), (1_200, 9)]) == {k: 3 if k < 1_200 else 9 for k in range(500, 2_001)}


def test_a_large_cycle_is_one_component(spark):
    n = 100_000
    ring = spark.range(n).select(
        F.lit("n").alias("src_type"), F.col("id").cast("string").alias("src_id"), F.lit("n").alias("dst_type"), ((F.col("id") + 1) % n).cast("string").alias("dst_id")
    )
    graph = cd.condense(ring)
    assert graph.levels == 1 and graph.rounds <= 30
    assert graph.nodes.select("component").distinct().count() == 1
    assert cd.closure_condensed(graph, spark.createDataFrame([("n", "17", 0)], SEED)).count() == n


def test_nothing(spark):
    graph = cd.condense(links(spark, [(1, 2)]).limit(0))
    assert values_of(spark, graph, [(4, 2)]) == {4: 2}
    graph = cd.condense(links(spark, [(1, 2), (2, 3)]))
    assert cd.spread_condensed(graph, spark.createDataFrame([], SEED)).count() == 0
