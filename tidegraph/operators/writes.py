"""Sequenced writes: which are accepted, what they change, and the state they leave.

A stream of writes to one key behaves like a fold: a write replaces the stored
row when nothing is stored, when the stored row has no sequence number, or when
its own number is larger.  An equal number is tolerated only with the same
content.  So the stored row is always the *largest* write so far under this
order: numbered before unnumbered; the larger number first; among equal numbers
the earliest; among unnumbered the latest.  A running maximum replaces the fold.

Writes are `(type, id, ord, ts, deleted, seq, body, attributes, relationships,
out_refs)` with `ord` a unique arrival number >= 0, `body` and the two parts as
canonical JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.jsontext import digest, member, parsed
from tidegraph.operators.ordering import previous_best
from tidegraph.schema import NODE
from tidegraph.skew import HOT_ROWS

# Arrival number of the row stored before the first write.
STORED = -1

PAYLOAD = ["deleted", "seq", "body", "out_refs"]


def _stored_as_writes(state: DataFrame) -> DataFrame:
    return state.withColumn("_doc", parsed(F.col("resource"))).select(
        *NODE,
        F.lit(STORED).cast("bigint").alias("ord"),
        F.col("updated").alias("ts"),
        "deleted",
        F.col("sequence_number").alias("seq"),
        F.col("resource").alias("body"),
        member(F.col("_doc"), "attributes").alias("attributes"),
        member(F.col("_doc"), "relationships").alias("relationships"),
        "out_refs",
        "created",
    )


def _rank() -> Column:
    """A struct whose order is the order of precedence; digests ride along for comparison."""
    return F.struct(
        F.col("seq"),
        F.when(F.col("seq").isNull(), F.col("ord")).otherwise(-F.col("ord")).alias("tie"),
        F.col("deleted"),
        F.col("_content").alias("content"),
        F.col("_core").alias("core"),
    )


def classify_writes(state: DataFrame | None, writes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every write with its `result`, whether it `advanced` the state, and whether it `changed` the resource.

    `result` is Created, Updated, NotModified or OutOfSequence.  `changed` is
    true for first writes, and for updates in which the deleted flag, the
    attributes or the relationships differ: those start change propagation.
    Stored rows pass through with `ord` = STORED and a NULL result.
    """
    rows = writes.select(
        *NODE, "ord", "ts", "deleted", "seq", "body", "attributes", "relationships", "out_refs"
    ).withColumn("created", F.lit(None).cast("timestamp"))
    if state is not None:
        touched = state.join(writes.select(*NODE).distinct(), NODE, "left_semi")
        rows = rows.unionByName(_stored_as_writes(touched))
    rows = rows.withColumn("_content", F.sha2("body", 256)).withColumn(
        "_core", digest(F.col("deleted"), F.col("attributes"), F.col("relationships"))
    )
    seen = previous_best(rows, NODE, "ord", _rank(), "prev", hot_rows)

    prev = F.col("prev")
    first = prev.isNull()
    advanced = first | prev["seq"].isNull() | F.coalesce(F.col("seq") > prev["seq"], F.lit(False))
    same_content = (F.col("deleted") == prev["deleted"]) & (F.col("_content") == prev["content"])
    repeated = F.coalesce(F.col("seq") == prev["seq"], F.lit(False)) & same_content
    same = F.col("seq").eqNullSafe(prev["seq"]) & same_content
    stored = F.col("ord") == STORED
    result = (
        F.when(stored, F.lit(None))
        .when(first, "Created")
        .when(~(advanced | repeated), "OutOfSequence")
        .when(same, "NotModified")
        .otherwise("Updated")
    )
    changed = ~stored & (first | (advanced & (F.col("_core") != prev["core"])))
    return seen.select(
        *NODE,
        "ord",
        "ts",
        *PAYLOAD,
        "created",
        result.alias("result"),
        advanced.alias("advanced"),
        changed.alias("changed"),
    )


def write_results(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("ord") != STORED).select(*NODE, "ord", "result")


def state_after(classified: DataFrame) -> DataFrame:
    """The resource rows of all keys in `classified`: the last write that advanced each.

    `created` is kept from the first write; `updated` moves only with a write
    that was Created or Updated.  Both come from the writes, not from the clock.
    """
    moved = F.col("result").isin("Created", "Updated") | F.col("result").isNull()
    heads = classified.groupBy(*NODE).agg(
        F.max_by(F.struct(*PAYLOAD), F.when(F.col("advanced"), F.col("ord"))).alias("head"),
        F.coalesce(F.min("created"), F.min_by("ts", "ord")).alias("created"),
        F.max_by("ts", F.when(moved, F.col("ord"))).alias("updated"),
    )
    return heads.select(
        *NODE,
        "head.deleted",
        F.col("head.body").alias("resource"),
        F.col("head.seq").alias("sequence_number"),
        "created",
        "updated",
        "head.out_refs",
    )


def merge_state(state: DataFrame, changed_rows: DataFrame) -> DataFrame:
    """The whole resource table: untouched rows of `state` and the rows of `state_after`."""
    return state.join(changed_rows.select(*NODE), NODE, "left_anti").unionByName(changed_rows.select(*state.columns))


def captured_changes(classified: DataFrame) -> DataFrame:
    """The queue of changed keys: `(key, type, id)`, keyed by arrival."""
    return classified.filter("changed").select(F.col("ord").alias("key"), *NODE)


def result_tally(results: DataFrame, batch: list[str]) -> DataFrame:
    """Per batch, how many writes had each result, and whether the batch is in conflict."""
    names = ["Created", "Updated", "NotModified", "OutOfSequence"]
    counts = [F.count(F.when(F.col("result") == name, 1)).alias(name) for name in names]
    return results.groupBy(*batch).agg(*counts).withColumn("conflict", F.col("OutOfSequence") > 0)


def conflict_report(results: DataFrame) -> DataFrame:
    """Out-of-sequence writes by position in their batch: `(batch_id, pointer, detail)`.

    `results` has `batch_id` and the zero-based `pos` next to the write results.
    """
    return results.filter("result = 'OutOfSequence'").select(
        "batch_id",
        F.format_string("/data(%d)", F.col("pos").cast("bigint")).alias("pointer"),
        F.to_json(F.struct(*NODE)).alias("detail"),
    )
