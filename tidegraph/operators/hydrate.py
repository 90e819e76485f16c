"""Hydration: a resource together with all it refers to, as flat rows.

Only live resources are entered.  Dangling references and deleted resources are
neither included nor crossed.  A root inside a cycle is included in its own
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.lineage import counted, settled
from tidegraph.operators.closure import adjacency, along_edges, closure, closure_each
from tidegraph.schema import NODE
from tidegraph.skew import MAX_HOT_KEYS, by_rows


def live_rows(resources: DataFrame) -> DataFrame:
    return resources.filter(~F.col("deleted"))


def lookup(resources: DataFrame, keys: DataFrame) -> DataFrame:
    """Live resources for a table of keys `(type, id)`."""
    return live_rows(resources).join(keys.select(*NODE), NODE, "left_semi")


def _heads(live: DataFrame, roots: DataFrame) -> DataFrame:
    """The keys of the live roots; they start the closure and are part of its result."""
    wanted, size = counted(roots.select(*NODE).distinct())
    return settled(live.select(*NODE).join(by_rows(wanted, size, MAX_HOT_KEYS), NODE[::-1], "left_semi").select(*NODE))


def hydrate_many(resources: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """One shared document for all roots: `(role, type, id, resource)`.

    `role` is `data` for live roots and `included` for the reachable set, which
    is closed once for all roots and holds each resource once.  The closure
    loop carries keys only; bodies are joined at the end.
    """
    live = live_rows(resources)
    heads = _heads(live, roots)
    reached = closure(adjacency(along_edges(edges), nodes=live), heads, include_seeds=False)
    picked = heads.withColumn("role", F.lit("data")).unionByName(reached.withColumn("role", F.lit("included")))
    return picked.join(live.select(*NODE, "resource"), NODE).select("role", *NODE, "resource")


def hydrate_keys(resources: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The keys of one document per live root: `(root_type, root_id, role, type, id)`, without the bodies."""
    live = live_rows(resources).select(*NODE)
    heads = _heads(live, roots)
    pairs = closure_each(along_edges(edges), heads, live).withColumn("role", F.lit("included"))
    own = heads.select(F.col("type").alias("root_type"), F.col("id").alias("root_id"), *NODE, F.lit("data").alias("role"))
    return own.unionByName(pairs).select("root_type", "root_id", "role", *NODE)


def hydrate_each(resources: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """One document per live root: `(root_type, root_id, role, type, id, resource)`."""
    keys = hydrate_keys(resources, edges, roots)
    bodies = live_rows(resources).select(*NODE, "resource")
    return keys.join(bodies, NODE).select("root_type", "root_id", "role", *NODE, "resource")


def documents(rows: DataFrame) -> DataFrame:
    """Hydrated rows of `hydrate_each` as one JSON document per root: `(root_type, root_id, document)`.

    `included` is sorted by type and id.  A document is one value, so its size is bounded
    by what a value may hold; the rows themselves are the form for documents beyond that.
    """
    root = ["root_type", "root_id"]
    data = rows.filter("role = 'data'").select(*root, F.col("resource").alias("data"))
    included = (
        rows.filter("role = 'included'")
        .groupBy(*root)
        .agg(F.sort_array(F.collect_list(F.struct(*NODE, "resource"))).alias("members"))
    )
    bodies = F.concat_ws(",", F.transform(F.col("members"), lambda m: m["resource"]))
    return data.join(included, root, "left").select(
        *root,
        F.concat(F.lit('{"data":'), F.col("data"), F.lit(',"included":['), bodies, F.lit("]}")).alias("document"),
    )


def list_document(rows: DataFrame) -> DataFrame:
    """Rows of `hydrate_many` as one JSON document: `data` lists the live roots, `included` what they reach.

    Both are sorted by type and id, and empty if there is nothing.
    """

    def part(role: str) -> Column:
        held = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct(*NODE, "resource"))))
        return F.concat_ws(",", F.transform(held, lambda m: m["resource"]))

    text = F.concat(F.lit('{"data":['), part("data"), F.lit('],"included":['), part("included"), F.lit("]}"))
    return rows.agg(text.alias("document"))
