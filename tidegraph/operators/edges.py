"""The edge table: extraction, upkeep, and one-hop lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.schema import NODE


def edges_of(resources: DataFrame) -> DataFrame:
    """All edges, from the `out_refs` of the resources."""
    return resources.select(
        F.col("type").alias("from_type"), F.col("id").alias("from_id"), F.explode("out_refs").alias("ref")
    ).select("from_type", "from_id", F.col("ref.type").alias("to_type"), F.col("ref.id").alias("to_id"))


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges to insert and to delete, for the resources in `after` only.

    Both sides are `(type, id, out_refs)`.  Returns the edge columns and `op`,
    which is `insert` or `delete`.
    """
    old = before.select(*NODE, F.col("out_refs").alias("old_refs"))
    none = F.array().cast("array<struct<type:string,id:string>>")
    both = after.select(*NODE, "out_refs").join(old, NODE, "left")
    new_refs, old_refs = F.coalesce("out_refs", none), F.coalesce("old_refs", none)
    return both.select(
        F.col("type").alias("from_type"),
        F.col("id").alias("from_id"),
        F.explode(
            F.concat(
                F.transform(
                    F.array_except(new_refs, old_refs), lambda r: F.struct(r.alias("ref"), F.lit("insert").alias("op"))
                ),
                F.transform(
                    F.array_except(old_refs, new_refs), lambda r: F.struct(r.alias("ref"), F.lit("delete").alias("op"))
                ),
            )
        ).alias("step"),
    ).select(
        "from_type",
        "from_id",
        F.col("step.ref.type").alias("to_type"),
        F.col("step.ref.id").alias("to_id"),
        F.col("step.op").alias("op"),
    )


def apply_edge_diff(edges: DataFrame, diff: DataFrame) -> DataFrame:
    """The edge table after a diff: stale edges removed, missing ones added once."""
    columns = ["from_type", "from_id", "to_type", "to_id"]
    stale = diff.filter("op = 'delete'").select(*columns)
    added = diff.filter("op = 'insert'").select(*columns)
    return edges.join(stale, columns, "left_anti").unionByName(added).dropDuplicates(columns)


def incoming_documents(resources: DataFrame, edges: DataFrame, targets: DataFrame, incoming_type: str) -> DataFrame:
    """Each live target with its live direct referrers: `(to_type, to_id, role, type, id, resource)`.

    `role` is `data` for the target, which is there also without referrers, and `included` for a referrer.
    """
    live = resources.filter(~F.col("deleted")).select(*NODE, "resource")
    own = live.join(targets.select(*NODE).distinct(), NODE, "left_semi").select(
        F.col("type").alias("to_type"), F.col("id").alias("to_id"), F.lit("data").alias("role"), *NODE, "resource"
    )
    referrers = incoming(resources, edges, targets, incoming_type).select(
        "to_type",
        "to_id",
        F.lit("included").alias("role"),
        F.col("from_type").alias("type"),
        F.col("from_id").alias("id"),
        "resource",
    )
    return own.unionByName(referrers)


def incoming(resources: DataFrame, edges: DataFrame, targets: DataFrame, incoming_type: str) -> DataFrame:
    """Live direct referrers of `incoming_type` for each live target `(type, id)`.

    A target that is missing or deleted yields nothing.
    """
    live = resources.filter(~F.col("deleted"))
    wanted = (
        targets.select(*NODE)
        .distinct()
        .join(live.select(*NODE), NODE, "left_semi")
        .select(F.col("type").alias("to_type"), F.col("id").alias("to_id"))
    )
    hops = edges.filter(F.col("from_type") == incoming_type).join(wanted, ["to_type", "to_id"], "left_semi").distinct()
    referrers = live.filter(F.col("type") == incoming_type).select(
        F.col("type").alias("from_type"), F.col("id").alias("from_id"), "resource"
    )
    return hops.join(referrers, ["from_type", "from_id"])
