"""Transitive closures over the resource graph.

`links` are directed hops `(src_type, src_id, dst_type, dst_id)`.  For change
propagation a hop goes from a resource to one that refers to it; for hydration
it goes from a resource to one it refers to.

The loop is semi-naive and bulk-synchronous.  Links and the table of reached
nodes are both hash-partitioned by node, so a round joins them in place, and the
only shuffle is that of the messages, which are combined on the map side first.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidegraph.lineage import counted, cut, fixed_partitioning, settled, small_splits
from tidegraph.schema import NODE
from tidegraph.skew import HOT_ROWS, MAX_HOT_KEYS, by_rows, key_load, partitions_for

SRC = ["src_type", "src_id"]
DST = ["dst_type", "dst_id"]
WORD = 64


@dataclass(frozen=True)
class Adjacency:
    """Links prepared for repeated joins.

    `cold` is hash-partitioned and sorted by source.  `hot` holds the links of
    hub nodes, spread evenly; `hubs` lists those nodes and is at most
    `MAX_HOT_KEYS` rows.  `nodes`, if set, restricts which nodes may be entered.
    """

    cold: DataFrame
    hot: DataFrame | None
    hubs: DataFrame | None
    nodes: DataFrame | None
    partitions: int


def against_edges(edges: DataFrame) -> DataFrame:
    """Links from a resource to its referrers: the direction in which changes travel."""
    return edges.select(
        F.col("to_type").alias("src_type"),
        F.col("to_id").alias("src_id"),
        F.col("from_type").alias("dst_type"),
        F.col("from_id").alias("dst_id"),
    )


def along_edges(edges: DataFrame) -> DataFrame:
    """Links from a resource to what it refers to: the direction of hydration."""
    return edges.select(
        F.col("from_type").alias("src_type"),
        F.col("from_id").alias("src_id"),
        F.col("to_type").alias("dst_type"),
        F.col("to_id").alias("dst_id"),
    )


def adjacency(links: DataFrame, nodes: DataFrame | None = None, hot_degree: int = HOT_ROWS) -> Adjacency:
    """Lay links out by source, hubs apart.  Repeated links are harmless and are kept."""
    spark = links.sparkSession
    cold = links.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), *DST)
    hot, hubs = None, None
    load = key_load(cold, NODE, hot_degree)
    partitions = partitions_for(load.rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if load.hot is not None:
        hubs = cut(load.hot)
        hot = cut(cold.join(F.broadcast(hubs), NODE, "left_semi").repartition(partitions))
        cold = cold.join(F.broadcast(hubs), NODE, "left_anti")
    with fixed_partitioning(spark, partitions):
        cold = cut(cold.repartition(partitions, *NODE).sortWithinPartitions(*NODE))
        if nodes is not None:
            nodes = nodes.select(*NODE).repartition(partitions, *NODE).dropDuplicates(NODE)
            nodes = cut(nodes.sortWithinPartitions(*NODE))
    return Adjacency(cold, hot, hubs, nodes, partitions)


@dataclass(frozen=True)
class TableLinks:
    """Links `(type, id, dst_type, dst_id, bucket)` of a table stored in hash buckets by source node.

    For few seeds on a large table: nothing is laid out anew, and a round reads
    only the buckets of its frontier, `bucket` being a partition column of the
    files.  `bucket_of` computes the bucket from `type` and `id`.
    """

    links: DataFrame
    bucket_of: Column


def spread(adj: Adjacency | TableLinks, seeds: DataFrame, include_seeds: bool = True) -> DataFrame:
    """Carry `value` from the seeds along the links; every node keeps the largest value that reaches it.

    `seeds` is `(type, id, value BIGINT)`.  Returns `(type, id, value)` for all
    nodes reached, the seeds being reached without a hop if `include_seeds`.
    The values only grow and come from the seeds, so the loop ends on any graph.
    """
    planning = (
        fixed_partitioning(seeds.sparkSession, adj.partitions) if isinstance(adj, Adjacency) else nullcontext()
    )
    with planning:
        start = seeds.groupBy(*NODE).agg(F.max("value").alias("value"))
        frontier = cut(start.withColumn("known", F.col("value")))
        reached = frontier if include_seeds else None
        while True:
            growth = Observation()
            merged = _merge(reached, _messages(adj, frontier))
            merged = cut(merged.observe(growth, F.count_if("fresh").alias("fresh")))
            reached = merged.select(*NODE, "value", "known")
            if growth.get["fresh"] == 0:
                return reached.select(*NODE, "value")
            frontier = merged.filter("fresh")


def _messages(adj: Adjacency | TableLinks, frontier: DataFrame) -> DataFrame:
    """The best value sent to each node in this round, with no value `known` to it yet."""
    if isinstance(adj, TableLinks):
        senders = frontier.select(*NODE, "value", adj.bucket_of.alias("bucket"))
        touched = [row[0] for row in senders.select("bucket").distinct().collect()]
        return (
            adj.links.filter(F.col("bucket").isin(touched))
            .join(senders, ["bucket", *NODE])
            .groupBy(F.col("dst_type").alias("type"), F.col("dst_id").alias("id"))
            .agg(F.max("value").alias("value"), F.max(F.lit(None).cast("bigint")).alias("known"))
        )
    sent = adj.cold.join(frontier.select(*NODE, "value").hint("merge"), NODE).select(*DST, "value")
    if adj.hot is not None:
        hub_senders = frontier.select(*NODE, "value").join(F.broadcast(adj.hubs), NODE, "left_semi")
        sent = sent.unionByName(adj.hot.join(F.broadcast(hub_senders), NODE).select(*DST, "value"))
    arrived = sent.groupBy(F.col("dst_type").alias("type"), F.col("dst_id").alias("id")).agg(
        F.max("value").alias("value"), F.max(F.lit(None).cast("bigint")).alias("known")
    )
    # Nodes are unique, so this is a semi join; written as one it would be pushed
    # below the aggregate and shuffle all links again.
    return arrived if adj.nodes is None else arrived.join(adj.nodes.hint("merge"), NODE)


def _merge(reached: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """Reached nodes after the round; `fresh` ones got a larger value than they knew and send it on."""
    best = arrived
    if reached is not None:
        best = (
            reached.unionByName(arrived)
            .groupBy(*NODE)
            .agg(F.max("value").alias("value"), F.max("known").alias("known"))
        )
    fresh = F.col("known").isNull() | (F.col("value") > F.col("known"))
    return best.select(*NODE, "value", F.col("value").alias("known"), fresh.alias("fresh"))


def closure(adj: Adjacency, seeds: DataFrame, include_seeds: bool = True) -> DataFrame:
    """Nodes `(type, id)` reachable from any seed."""
    marked = seeds.select(*NODE, F.lit(0).cast("bigint").alias("value"))
    return spread(adj, marked, include_seeds).select(*NODE)


def reverse_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds and everything that refers to them, directly or not.

    Uses edges only: a seed need not exist as a resource.
    """
    return closure(adjacency(against_edges(edges)), seeds)


def max_relevant_seq(seqs: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest sequence number of each resource and of all it refers to, directly or not.

    `seqs` is `(type, id, seq)`; returns `(type, id, max_seq)`.
    """
    seeds = seqs.select(*NODE, F.col("seq").alias("value"))
    return spread(adjacency(against_edges(edges)), seeds).withColumnRenamed("value", "max_seq")


def _bits(mask: Column) -> Column:
    """The places of the bits set in a BIGINT, most masks having one only."""
    several = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.call_function("getbit", mask, k) == 1)
    last = mask == F.lit(-(1 << (WORD - 1)))  # has no predecessor
    single = F.when(last, F.lit(WORD - 1)).otherwise(F.bit_count(F.when(last, 1).otherwise(mask) - 1))
    return F.when(F.bit_count(mask) == 1, F.array(single)).otherwise(several)


TYPES = 1_000  # up to so many types, links are read type by type


def types_in(df: DataFrame) -> list[str] | None:
    """The types in `df`, None if there are more than `TYPES`."""
    rows = df.filter("type IS NOT NULL").select("type").distinct().limit(TYPES + 1).collect()
    return None if len(rows) > TYPES else sorted(row[0] for row in rows)


def of_types(df: DataFrame, types: list[str] | None) -> DataFrame:
    return df if types is None else df.filter(F.col("type").isin(types))


def rows_per_type(df: DataFrame) -> dict[str, int] | None:
    """How many rows `df` has of each type, None if there are more than `TYPES`."""
    counts = df.filter("type IS NOT NULL").groupBy("type").agg(F.count(F.lit(1)).alias("rows")).limit(TYPES + 1).collect()
    return None if len(counts) > TYPES else {row["type"]: row["rows"] for row in counts}


def _entering(nodes: DataFrame | None) -> Callable[[DataFrame], DataFrame]:
    """Keeps the links that lead to `nodes`: small types are looked up in a broadcast of `MAX_HOT_KEYS` rows at most."""
    if nodes is None:
        return lambda hops: hops
    allowed = nodes.select(F.col("type").alias("dst_type"), F.col("id").alias("dst_id"))
    sizes, few, total = rows_per_type(nodes), [], 0
    for type_, rows in sorted((sizes or {}).items(), key=lambda size: size[1]):
        total += rows
        if total <= MAX_HOT_KEYS:
            few.append(type_)
    is_few = F.col("dst_type").isin(few)

    def entered(hops: DataFrame) -> DataFrame:
        if not few:
            return hops.join(allowed.hint("merge"), DST[::-1], "left_semi")
        into_few = hops.filter(is_few).join(F.broadcast(allowed.filter(is_few)), DST[::-1], "left_semi")
        if len(few) == len(sizes):
            return into_few
        others = hops.filter(~is_few).join(allowed.filter(~is_few).hint("merge"), DST[::-1], "left_semi")
        return into_few.unionByName(others)

    return entered


@dataclass(frozen=True)
class _Part:
    """Stored links out of nodes of the types `sources`, None for types too many to name."""

    links: DataFrame
    sources: list[str] | None
    rows: int | None

    def sent(self, frontier: DataFrame) -> DataFrame:
        """What the frontier sends along these links."""
        links = self.links.hint("merge") if self.rows is None else by_rows(self.links, self.rows, MAX_HOT_KEYS)
        return of_types(frontier, self.sources).join(links, NODE[::-1]).select("word", *DST, "mask")


@dataclass
class _Inner:
    """Links out of what was reached: those of a type are filtered and stored when a node of it is first reached.

    What is stored at once is a part of its own, so a round reads only links out of types of its frontier.
    """

    links: DataFrame
    entered: Callable[[DataFrame], DataFrame]
    parts: list[_Part] = field(default_factory=list)
    loaded: set[str] | None = field(default_factory=set)

    def out_of(self, types: list[str] | None) -> list[_Part]:
        """Stored parts with links out of `types`."""
        if self.loaded is not None and (types is None or set(types) - self.loaded):
            more = None if types is None else sorted(set(types) - self.loaded)
            stored = settled(self.entered(of_types(self.links, more)))
            sizes = rows_per_type(stored)
            part = _Part(stored, None, None) if sizes is None else _Part(stored, sorted(sizes), sum(sizes.values()))
            self.parts = [part] if more is None else [*self.parts, part]
            self.loaded = None if more is None else self.loaded | set(more)
        return [p for p in self.parts if p.sources is None or (p.sources if types is None else set(types) & set(p.sources))]


def closure_each(links: DataFrame, roots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Per root, the nodes reachable in one hop or more: `(root_type, root_id, type, id)`.

    `nodes`, if set, restricts which nodes may be entered.  The first hop, which mostly leads to nodes that few roots
    share, is a table of root and node: links meet the roots once and repeated ones go in place.  From there it is a
    multi-source search by bitmaps: roots are numbered, 64 to a word, and a word travels with one mask per node
    instead of one row per root.  Masks that meet are merged by `bit_or`, and a round sends on only bits that are new to
    a node.  Only links of types that were reached are laid out for that.  Each round's new bits are a table of their own; what
    arrives is compared with the rows of the same nodes only, found by a broadcast of these where they are few.
    Tables are broadcast by their number of rows only: a few bytes a row in a file are a hundred or more on the driver.
    Rows of root and node come into being at the end.  The answer has one of them per root and node, so use `closure`
    where one shared set will do.
    """
    with small_splits(links.sparkSession):
        return _closure_each(links, roots, nodes)


def _closure_each(links: DataFrame, roots: DataFrame, nodes: DataFrame | None) -> DataFrame:
    links = links.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"), *DST)
    entered = _entering(nodes)
    heads, n_heads = counted(roots.select(*NODE).distinct().withColumn("_at", F.monotonically_increasing_id()))
    few = n_heads <= MAX_HOT_KEYS
    out = of_types(links, types_in(heads))
    # Few roots pick their links first; of many, links are filtered first, as they are narrower than what they lead to.
    starts = by_rows(heads, n_heads, MAX_HOT_KEYS)
    hops = entered(out.join(starts, NODE[::-1]).distinct()) if few else entered(out).join(starts, NODE[::-1]).distinct()
    root = [F.col("type").alias("root_type"), F.col("id").alias("root_id")]
    near = settled(hops.select(*root, "_at", F.col("dst_type").alias("type"), F.col("dst_id").alias("id")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_at") % WORD).cast("int"))
    word = F.floor(F.col("_at") / WORD).alias("word")
    frontier = near.select(word, *NODE, bit.alias("mask"))
    found, far, types = frontier, None, types_in(frontier)
    inner = _Inner(links, entered)
    while ahead := inner.out_of(types):
        fresh, types = _new_bits(found, frontier, ahead)
        frontier, size = counted(fresh)
        if not size:
            break
        found = found.unionByName(frontier)
        far = frontier if far is None else far.unionByName(frontier)
    pairs = near.select("root_type", "root_id", *NODE)
    if far is None:
        return pairs
    # The names of a word's roots, by place: at most 64.
    named = heads.withColumn("word", word).groupBy("word")
    named = named.agg(F.sort_array(F.collect_list(F.struct("_at", *root))).alias("_names"))
    # A node's bits are spread over the rounds in which they arrived, each bit in one of them.
    shared = far.join(F.broadcast(named) if few else named.hint("merge"), "word")
    shared = shared.select(*NODE, "_names", F.explode(_bits(F.col("mask"))).alias("_bit")).withColumn("_root", F.col("_names")[F.col("_bit")])
    return pairs.unionByName(shared.select("_root.root_type", "_root.root_id", *NODE))


def _new_bits(found: DataFrame, frontier: DataFrame, ahead: list[_Part]) -> tuple[DataFrame, list[str] | None]:
    """Bits `(word, type, id, mask)` that the frontier sends along the links and that are not yet `found`; types they may be of."""
    key = ["word", *NODE]
    sent = reduce(DataFrame.unionByName, [part.sent(frontier) for part in ahead])
    arrived = sent.groupBy("word", F.col("dst_type").alias("type"), F.col("dst_id").alias("id"))
    arrived = settled(arrived.agg(F.bit_or("mask").alias("mask")))
    places, size = counted(arrived.select(*NODE).distinct())
    types = types_in(places)
    seen = of_types(found, types)
    if size <= MAX_HOT_KEYS:
        seen = seen.join(F.broadcast(places), NODE, "left_semi")
    none = F.lit(0).cast("bigint")
    both = arrived.select(*key, "mask", none.alias("_known")).unionByName(seen.select(*key, none.alias("mask"), F.col("mask").alias("_known")))
    both = both.groupBy(*key).agg(F.bit_or("mask").alias("mask"), F.bit_or("_known").alias("_known"))
    return both.select(*key, F.col("mask").bitwiseAND(F.bitwise_not(F.col("_known"))).alias("mask")).filter("mask <> 0"), types
