"""Strongly connected components, and closures that run once per level of the condensed graph.

`condense` prepares links `(src_type, src_id, dst_type, dst_id)` for any number of closures:

* Links to leaves, nodes without a link of their own, are set apart: they lie on no cycle and pass nothing on.
* The other nodes become numbers, so the loops move two integers per link.
* Runs of nodes with one link in and one out are folded by pointer doubling, so a chain or a cycle of n
  such nodes costs log n rounds.  Nodes with no link in or none out are components of their own and are trimmed.
* What is left is coloured: the largest number that reaches a node (forward) is its colour; nodes from which
  that number can be reached within the colour (backward) are one component.  Labels jump along labels.
* Components with their links form a DAG.  Its runs are folded too, and the rest gets levels: a link
  always leads to a higher level.

`spread_condensed` then carries values level by level.  A component takes the largest value that it was sent and
sends it on once; a message is written once, under the level of its target, and read once.  So a closure takes as many rounds as
there are levels, whatever cycles there are, and nothing reached before is rewritten.  Leaves come last, in one join.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidegraph.lineage import counted, settled, shared_folder
from tidegraph.operators.closure import DST, SRC, against_edges, of_types, types_in
from tidegraph.operators.ordering import previous_best, with_sequence
from tidegraph.schema import NODE
from tidegraph.skew import MAX_HOT_KEYS


@dataclass(frozen=True)
class Condensed:
    """`nodes` (type, id, component) but for leaves; `links` (src, dst, level, dst_level) between components outside runs;

    `components` (component, level) of those; `runs` (component, head, tail, place, first) of components that lie on a run,
    numbered from 1 behind its head, and its first component; `leaves` (type, id, dst_type, dst_id), the links to leaves;
    `levels` is how many levels there are, `rounds` how many rounds preparing took.
    """

    nodes: DataFrame
    components: DataFrame
    links: DataFrame
    runs: DataFrame
    leaves: DataFrame
    levels: int
    rounds: int


@dataclass
class _Rounds:
    n: int = 0


def _degrees(links: DataFrame) -> DataFrame:
    """(n, ins, outs, prev, next) for every node; `prev` and `next` mean something where the degree is 1."""
    ends = links.select(F.explode(F.array(
        F.struct(F.col("b").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("a").alias("p"), F.lit(None).cast("bigint").alias("q")),
        F.struct(F.col("a").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("bigint").alias("p"), F.col("b").alias("q")),
    )).alias("e")).select("e.*")
    return ends.groupBy("n").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"), F.max("p").alias("prev"), F.max("q").alias("next"))


def _doubled(inner: DataFrame, size: int, rounds: _Rounds) -> DataFrame:
    """Runs of nodes (n, prev, next), each with one link in and one out, followed to both ends.

    Returns (n, prev, next, dist, first, low): `prev` and `next` become the nodes before and behind the run, `dist` the place
    in it and `first` its first node.  A run that is a cycle has no ends: `dist` is 0 and `low` its least number.
    """
    state = inner.select("n", "prev", "next", F.lit(1).cast("bigint").alias("dist"), F.col("n").alias("first"), F.col("n").alias("low"))
    span = 1
    while True:
        rounds.n += 1
        back = state.select(F.col("n").alias("prev"), F.col("prev").alias("_p"), F.col("dist").alias("_d"), F.col("first").alias("_f"), F.col("low").alias("_l"))
        on = state.select(F.col("n").alias("next"), F.col("next").alias("_q"))
        state = state.join(back, "prev", "left").join(on, "next", "left").select(
            "n",
            F.coalesce("_p", "prev").alias("prev"),
            F.coalesce("_q", "next").alias("next"),
            (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"),
            F.coalesce("_f", "first").alias("first"),
            F.least("low", "_l").alias("low"),
            F.col("_p").isNotNull().alias("before"),
            F.col("_q").isNotNull().alias("behind"),
        )
        moved = Observation()
        state = settled(state.observe(moved, F.count_if(F.col("before") | F.col("behind")).alias("open")))
        span *= 2
        # Beyond twice the number of nodes only cycles still find a successor among themselves.
        if moved.get["open"] == 0 or span > 2 * size:
            cyclic = F.col("before") & F.col("behind")
            return state.select("n", "prev", "next", F.when(cyclic, 0).otherwise(F.col("dist")).cast("bigint").alias("dist"), "first", "low")


def _without(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links that touch none of the nodes `gone` (n)."""
    kept = links.join(gone.select(F.col("n").alias("a")), "a", "left_anti")
    return kept.join(gone.select(F.col("n").alias("b")), "b", "left_anti").select("a", "b")


@dataclass(frozen=True)
class _Shape:
    """Degrees of all nodes of some links, how many are ends (no link in, or none out) and how many lie inside a run."""

    degrees: DataFrame
    ends: int
    inner: int


def _shape(links: DataFrame) -> _Shape:
    seen = Observation()
    is_end, is_inner = (F.col("ins") == 0) | (F.col("outs") == 0), (F.col("ins") == 1) & (F.col("outs") == 1)
    held = settled(_degrees(links).observe(seen, F.count_if(is_end).alias("ends"), F.count_if(is_inner).alias("inner")))
    return _Shape(held, seen.get["ends"], seen.get["inner"])


def _folded(links: DataFrame, shape: _Shape, rounds: _Rounds) -> tuple[DataFrame, DataFrame | None]:
    """Links with every run replaced by one from its head to its tail, and the runs."""
    if not shape.inner:
        return links, None
    runs = _doubled(shape.degrees.filter("ins = 1 AND outs = 1"), shape.inner, rounds)
    bridges = runs.filter("dist = 1").select(F.col("prev").alias("a"), F.col("next").alias("b")).filter("a <> b")
    return _without(links, runs).unionByName(bridges).distinct(), runs


def _largest_reaching(links: DataFrame, rounds: _Rounds) -> DataFrame:
    """(n, label): the largest number from which each node can be reached, its own included."""
    labels = settled(links.select(F.explode(F.array("a", "b")).alias("n")).distinct().withColumn("label", F.col("n")))
    while True:
        rounds.n += 1
        sent = links.join(labels.withColumnRenamed("n", "a"), "a").groupBy(F.col("b").alias("n")).agg(F.max("label").alias("_sent"))
        got = labels.join(sent, "n", "left").select("n", F.col("label").alias("_was"), F.greatest("label", "_sent").alias("_now"))
        # What reaches the sender of a label reaches the node too.
        jump = labels.select(F.col("n").alias("_now"), F.col("label").alias("_jump"))
        moved = got.join(jump, "_now").select("n", F.greatest("_now", "_jump").alias("label"), "_was")
        growth = Observation()
        moved = settled(moved.observe(growth, F.count_if(F.col("label") > F.col("_was")).alias("up")))
        labels = moved.select("n", "label")
        if growth.get["up"] == 0:
            return labels


def _labelled(links: DataFrame, rounds: _Rounds) -> DataFrame:
    """(n, component) of nodes that share a component with another; the others are their own."""
    found: list[DataFrame] = []
    folds: list[DataFrame] = []
    while True:
        rounds.n += 1
        shape = _shape(links)
        folded, runs = _folded(links, shape, rounds)
        if runs is not None:
            folds.append(runs)
            found.append(runs.filter("dist = 0").select("n", F.col("low").alias("component")))
        if shape.ends:
            folded = _without(folded, shape.degrees.filter("ins = 0 OR outs = 0"))
        if shape.ends or shape.inner:
            links = settled(folded)
            continue
        if links.isEmpty():
            break
        forward = _largest_reaching(links, rounds)
        one = links.join(forward.select(F.col("n").alias("a"), F.col("label").alias("_a")), "a")
        both = one.join(forward.select(F.col("n").alias("b"), F.col("label").alias("_b")), "b")
        inside = settled(both.filter("_a = _b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        backward = _largest_reaching(inside, rounds)
        # A root alone in its colour has no link inside and is a component of its own.
        same = forward.join(backward.withColumnRenamed("label", "_back"), "n").filter("label = _back")
        found.append(settled(same.select("n", F.col("label").alias("component"))))
        links = settled(_without(inside.select(F.col("b").alias("a"), F.col("a").alias("b")), found[-1]))
    if not found:
        return links.select(F.col("a").alias("n"), F.col("b").alias("component")).limit(0)
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    known = settled(known)
    # A run lies within a component if its ends do; later folds hold the ends of earlier ones.
    for runs in reversed(folds):
        own = runs.filter("dist > 0").select("n", F.col("prev").alias("_p"), F.col("next").alias("_q"))
        head = known.select(F.col("n").alias("_p"), F.col("component").alias("_c"))
        tail = known.select(F.col("n").alias("_q"), F.col("component").alias("_d"))
        ended = own.join(head, "_p", "left").join(tail, "_q", "left")
        at_head, at_tail = F.coalesce("_c", "_p"), F.coalesce("_d", "_q")
        inner = ended.filter(at_head == at_tail).select("n", at_head.alias("component"), "_p")
        heads = inner.filter("component = _p").select(F.col("_p").alias("n"), "component").distinct()
        joined = inner.select("n", "component").unionByName(heads)
        known = settled(known.unionByName(joined.join(known.select("n"), "n", "left_anti")))
    return known


def _levelled(links: DataFrame, rounds: _Rounds) -> tuple[DataFrame, int]:
    """(n, level) of the nodes of a DAG: a node's level is known once all that link to it have theirs."""
    open_ = _degrees(links).select("n", F.col("ins").cast("bigint").alias("missing"))
    state, level = open_.withColumn("level", F.when(F.col("missing") == 0, F.lit(0))), 0
    while True:
        met = Observation()
        state = settled(state.observe(met, F.count_if(F.col("level") == level).alias("rows")))
        if met.get["rows"] == 0:
            return state.select("n", "level"), level
        rounds.n += 1
        here = state.filter(F.col("level") == level).select(F.col("n").alias("a"))
        seen = links.join(here, "a").groupBy(F.col("b").alias("n")).agg(F.count(F.lit(1)).alias("_seen"))
        left = F.col("missing") - F.coalesce("_seen", F.lit(0))
        known = F.coalesce("level", F.when(left == 0, F.lit(level + 1)))
        state = state.join(seen, "n", "left").select("n", left.alias("missing"), known.alias("level"))
        level += 1


def condense(links: DataFrame) -> Condensed:
    """Components, the DAG they form, its runs and its levels.  Repeated links and loops are harmless."""
    rounds = _Rounds()
    senders = links.select(*(F.col(c).alias(n) for c, n in zip(SRC, NODE, strict=True))).distinct()
    numbered = settled(with_sequence(senders, NODE, "n"))
    a = numbered.select(F.col("type").alias("src_type"), F.col("id").alias("src_id"), F.col("n").alias("a"))
    b = numbered.select(F.col("type").alias("dst_type"), F.col("id").alias("dst_id"), F.col("n").alias("b"))
    # Nodes of a type that sends nothing are leaves without a look at the senders.
    types = types_in(numbered)
    sending = F.lit(True) if types is None else F.coalesce(F.col("dst_type").isin(types), F.lit(False))
    marked = links.filter(sending).join(b, DST, "left").unionByName(links.filter(~sending).withColumn("b", F.lit(None).cast("bigint")))
    marked = settled(marked.select(*SRC, *DST, "b"))
    leaves = marked.filter("b IS NULL").select(*(F.col(c).alias(n) for c, n in zip(SRC, NODE, strict=True)), *DST)
    pairs = settled(marked.filter("b IS NOT NULL").join(a, SRC).filter("a <> b").select("a", "b").distinct())
    labels = _labelled(pairs, rounds)
    least = labels.groupBy("component").agg(F.min("n").alias("_least"))
    labels = settled(labels.join(least, "component").select("n", F.col("_least").alias("component")))
    nodes = settled(numbered.join(labels, "n", "left").select(*NODE, F.coalesce("component", "n").alias("component")))
    one = pairs.join(labels.select(F.col("n").alias("a"), F.col("component").alias("_a")), "a", "left")
    both = one.join(labels.select(F.col("n").alias("b"), F.col("component").alias("_b")), "b", "left")
    dag = both.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b")
    dag = settled(dag.distinct())
    kernel, runs = _folded(dag, _shape(dag), rounds)
    kernel = settled(kernel)
    levels, n_levels = _levelled(kernel, rounds)
    none = kernel.select(*(F.col("a").alias(c) for c in ("n", "prev", "next", "dist", "first"))).limit(0)
    on_run = (none if runs is None else runs).select(
        F.col("n").alias("component"), F.col("prev").alias("head"), F.col("next").alias("tail"), F.col("dist").alias("place"), "first"
    )
    src = levels.select(F.col("n").alias("a"), "level")
    dst = levels.select(F.col("n").alias("b"), F.col("level").alias("dst_level"))
    levelled = settled(kernel.join(src, "a").join(dst, "b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "level", "dst_level"))
    alone = nodes.select("component").distinct().join(on_run.select("component"), "component", "left_anti")
    held = alone.join(levels.withColumnRenamed("n", "component"), "component", "left")
    components = settled(held.select("component", F.coalesce("level", F.lit(0)).alias("level")))
    return Condensed(nodes, components, levelled, settled(on_run), leaves, max(n_levels, 1), rounds.n)


def strong_components(graph: Condensed) -> DataFrame:
    """`(type, id, component_type, component_id, members)`: the least member of each node's component, and how many there are."""
    nodes = graph.nodes
    named = nodes.groupBy("component").agg(F.min(F.struct(*NODE)).alias("_least"), F.count(F.lit(1)).alias("members"))
    inner = nodes.join(named, "component").select(*NODE, F.col("_least.type").alias("component_type"), F.col("_least.id").alias("component_id"), "members")
    leaves = graph.leaves.select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id")).distinct()
    alone = [F.col("type").alias("component_type"), F.col("id").alias("component_id"), F.lit(1).cast("bigint").alias("members")]
    return inner.unionByName(leaves.select(*NODE, *alone))


def spread_condensed(graph: Condensed, seeds: DataFrame) -> DataFrame:
    """As `closure.spread` with the seeds included: `(type, id, value)`, the largest value that reaches each node."""
    spark = seeds.sparkSession
    folder = f"{shared_folder(spark)}/levels-{uuid.uuid4()}"
    seeds = seeds.select(*NODE, "value").groupBy(*NODE).agg(F.max("value").alias("value"))
    placed = settled(seeds.join(graph.nodes, NODE, "left"))
    own = placed.filter("component IS NOT NULL").groupBy("component").agg(F.max("value").alias("value"))

    # Along a run, values of the components before a component are carried by a running maximum.
    runs = graph.runs.join(own, "component", "left")
    runs = settled(previous_best(runs, ["first"], "place", F.col("value"), "_before").withColumn("local", F.greatest("value", "_before")))
    ends = runs.filter("local IS NOT NULL").groupBy(F.col("tail").alias("component")).agg(F.max("local").alias("value"))
    first = own.unionByName(ends).join(graph.components, "component").select("component", "value", "level")
    first.write.partitionBy("level").parquet(f"{folder}/messages")
    schema, values = "component bigint, value bigint, level int", own.select("component", "value").limit(0)
    for level in range(graph.levels):
        inbox = spark.read.schema(schema).parquet(f"{folder}/messages").filter(F.col("level") == level)
        best, size = counted(inbox.groupBy("component").agg(F.max("value").alias("value")))
        if not size:
            continue
        values = values.unionByName(best)
        sent = graph.links.filter(F.col("level") == level).drop("level").join(best.withColumnRenamed("component", "src"), "src")
        sent = sent.groupBy(F.col("dst").alias("component"), F.col("dst_level").alias("level")).agg(F.max("value").alias("value"))
        sent.write.mode("append").partitionBy("level").parquet(f"{folder}/messages")
    heads = values.select(F.col("component").alias("head"), F.col("value").alias("_head"))
    inner = runs.join(heads, "head", "left").select("component", F.greatest("local", "_head").alias("value"))
    reached = values.unionByName(inner.filter("value IS NOT NULL"))
    inside, size = counted(graph.nodes.join(reached, "component").select(*NODE, "value"))
    outside = placed.filter("component IS NULL").select(*NODE, "value")
    if not size:
        return outside
    senders = F.broadcast(inside) if size <= MAX_HOT_KEYS else inside
    sent = of_types(graph.leaves, types_in(inside)).filter("dst_type IS NOT NULL AND dst_id IS NOT NULL").join(senders, NODE)
    sent = sent.select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id"), "value")
    # A leaf may be a seed too.
    return inside.unionByName(outside.unionByName(sent).groupBy(*NODE).agg(F.max("value").alias("value")))


def closure_condensed(graph: Condensed, seeds: DataFrame) -> DataFrame:
    """The seeds and all nodes reachable from them: `(type, id)`."""
    return spread_condensed(graph, seeds.select(*NODE, F.lit(0).cast("bigint").alias("value"))).select(*NODE)


def condense_referrers(edges: DataFrame) -> Condensed:
    """The condensed graph in the direction in which changes travel."""
    return condense(against_edges(edges))
