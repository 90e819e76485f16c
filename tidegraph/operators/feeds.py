"""The changefeed registry and acknowledgements.

Requests of a kind are judged in the order of `ord`, each against what the earlier ones left,
so it does not matter where a stream of them is cut into batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.columns import clamp_scalar, iso_utc
from tidegraph.lineage import cut
from tidegraph.operators.ordering import previous_best
from tidegraph.skew import HOT_ROWS, join_unique

EVER = -(1 << 63)


def registry(feeds: DataFrame, history: DataFrame) -> DataFrame:
    """Feeds with `parent_max_ack` and `max_event_time`.

    `parent_max_ack` is the parent's acknowledged position, for root feeds the
    log maximum, 0 on an empty log.  `max_event_time` is that of the newest row
    whose type is in the filter, NULL without a filter.
    """
    return registry_from(feeds, newest_per_type(history))


def newest_per_type(history: DataFrame) -> DataFrame:
    """The newest row of each type: `(type, seq, at)`."""
    return history.groupBy("type").agg(F.max("seq").alias("seq"), F.max_by("event_time", "seq").alias("at"))


def merge_newest(newest: DataFrame, fresh: DataFrame) -> DataFrame:
    """`newest_per_type` kept up with log rows that came since.

    Numbers only grow and compaction drops only rows that a newer one of the same type replaces, so the
    maxima of the parts are those of the whole log; only the new rows are read.
    """
    both = newest.unionByName(newest_per_type(fresh))
    return both.groupBy("type").agg(F.max("seq").alias("seq"), F.max_by("at", "seq").alias("at"))


def parent_bounds(feeds: DataFrame, top: Column) -> DataFrame:
    """Feeds with `parent_max_ack`; `top` is the log maximum, NULL for an empty log."""
    parents = feeds.select(F.col("id").alias("parent_id"), F.col("max_ack").alias("_parent_ack"))
    return feeds.join(parents, "parent_id", "left").select(
        *feeds.columns, F.coalesce("_parent_ack", top, F.lit(0)).alias("parent_max_ack")
    )


def registry_from(feeds: DataFrame, newest: DataFrame) -> DataFrame:
    """`registry` from the newest row of each type instead of the log."""
    filtered = feeds.select("id", F.explode("type_filter").alias("type"))
    event_times = filtered.join(newest, "type").groupBy("id").agg(F.max_by("at", "seq").alias("max_event_time"))
    bounded = parent_bounds(feeds, newest.agg(F.max("seq")).scalar())
    return bounded.join(event_times, "id", "left").select(*bounded.columns, "max_event_time")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page of the registry by id; the page is at least 0, the size 1 to 100."""
    number, size = clamp_scalar(number, 0), clamp_scalar(size, 1, 100)
    return rows.orderBy("id").offset(number * size).limit(size)


def page_links(number: int, size: int, rows: int) -> dict[str, int | None]:
    """Page numbers to link to: `next` only after a full page (of the clamped size), `prev` only after the first."""
    number, size = clamp_scalar(number, 0), clamp_scalar(size, 1, 100)
    return {
        "self": number,
        "first": 0,
        "prev": number - 1 if number > 0 else None,
        "next": number + 1 if rows == size else None,
    }


def describe(rows: DataFrame) -> DataFrame:
    """Registry rows as JSON-API documents: `(id, document)`; absent values are left out."""
    parent = F.when(
        F.col("parent_id").isNotNull(),
        F.struct(F.struct(F.lit("changefeed").alias("type"), F.col("parent_id").alias("id")).alias("data")),
    )
    attributes = F.struct(
        F.col("max_ack").alias("maxAck"),
        F.col("parent_max_ack").alias("parentMaxAck"),
        iso_utc(F.col("max_event_time")).alias("maxEventTime"),
        F.col("type_filter").alias("typeFilter"),
        iso_utc(F.col("created")).alias("created"),
        iso_utc(F.col("last_ack")).alias("lastAck"),
    )
    document = F.struct(
        F.lit("changefeed").alias("type"),
        F.col("id"),
        attributes.alias("attributes"),
        F.struct(parent.alias("parent")).alias("relationships"),
    )
    return rows.select("id", F.to_json(document).alias("document"))


def check_creates(feeds: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests `(ord, id, type_filter, parent_id, ts)` with `outcome`: created, duplicate or unknown_parent.

    A request is a duplicate only of a feed that exists or of an earlier request that succeeded.
    A parent may be created by an earlier request.  One round per level of new
    parents moves the time a feed comes to exist to the earliest request that can succeed.
    """
    requests = cut(requests)
    existing = cut(feeds.select("id", F.lit(EVER).alias("_since")))
    wanted = requests.select("ord", "id", "parent_id").join(existing.select("id"), "id", "left_anti")
    made = existing.limit(0)
    while True:
        parents = existing.unionByName(made).withColumnsRenamed({"id": "parent_id", "_since": "_parent_since"})
        able = join_unique(wanted, parents, ["parent_id"]).filter("parent_id IS NULL OR _parent_since < ord")
        fresh = cut(able.groupBy("id").agg(F.min("ord").alias("_since")))
        moved = fresh.join(made.withColumnRenamed("_since", "_was"), "id", "left").filter("_was IS NULL OR _was <> _since")
        settled = not moved.limit(1).count()
        made = fresh
        if settled:
            break
    outcome = (
        F.when(F.col("ord") > F.col("_since"), "duplicate").when(F.col("ord") == F.col("_since"), "created").otherwise("unknown_parent")
    )
    return requests.join(existing.unionByName(made), "id", "left").select(*requests.columns, outcome.alias("outcome"))


def create_feeds(feeds: DataFrame, checked: DataFrame) -> DataFrame:
    """The registry with the created feeds added, at position 0."""
    fresh = checked.filter("outcome = 'created'").select(
        "id",
        "parent_id",
        "type_filter",
        F.lit(0).cast("bigint").alias("max_ack"),
        F.col("ts").alias("created"),
        F.col("ts").alias("last_ack"),
    )
    return feeds.unionByName(fresh.select(*feeds.columns))


def check_deletes(feeds: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests `(ord, id)` with `outcome`: deleted, has_children or unknown.

    A feed can go once all its children are gone, which one round per level finds from the
    leaves up.  After that it is unknown.
    """
    requests = cut(requests.select("ord", "id"))
    tree = cut(feeds.select("id", "parent_id"))
    asked = requests.join(tree, "id")
    gone = cut(tree.select("id", F.lit(EVER).alias("_gone")).limit(0))
    children = cut(tree.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("_children")))
    while True:
        left = tree.join(gone, "id").groupBy(F.col("parent_id").alias("id")).agg(
            F.count(F.lit(1)).alias("_left"), F.max("_gone").alias("_free")
        )
        free = (
            asked.select("ord", "id")
            .join(children, "id", "left")
            .join(left, "id", "left")
            .filter("_children IS NULL OR _children = _left")
            .filter(F.col("ord") > F.coalesce("_free", F.lit(EVER)))
        )
        fresh = cut(free.groupBy("id").agg(F.min("ord").alias("_gone")))
        settled = fresh.count() == gone.count()
        gone = fresh
        if settled:
            break
    known = tree.select("id", F.lit(True).alias("_exists"))
    unknown = F.col("_exists").isNull() | F.coalesce(F.col("ord") > F.col("_gone"), F.lit(False))
    outcome = F.when(unknown, "unknown").when(F.col("ord") == F.col("_gone"), "deleted").otherwise("has_children")
    return (
        requests.join(known, "id", "left").join(gone, "id", "left").select("ord", "id", outcome.alias("outcome"))
    )


def delete_feeds(feeds: DataFrame, checked: DataFrame) -> DataFrame:
    return feeds.join(checked.filter("outcome = 'deleted'").select("id"), "id", "left_anti")


def check_acks(registered: DataFrame, acks: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Acks `(ord, id, ack, ts)` with `outcome`: accepted, beyond_parent or unknown.

    `registered` has `parent_id` and `parent_max_ack`.  An ack may go as far as its parent has
    acknowledged before it, earlier acks of these included; one round per level of
    feeds that have acks here, parents first.  One feed may get most of the acks.
    """
    bounds = registered.select("id", F.col("parent_id").alias("_parent"), "parent_max_ack")
    waiting = cut(join_unique(acks, bounds, ["id"], hot_rows))
    columns = [*acks.columns, "parent_max_ack", "outcome"]
    judged = None
    while True:
        parents = waiting.select(F.col("id").alias("_parent")).distinct()
        ready = waiting.join(parents, "_parent", "left_anti")
        now = _bounded(ready, judged, hot_rows)
        outcome = (
            F.when(F.col("parent_max_ack").isNull(), "unknown")
            .when(F.col("ack") > F.col("parent_max_ack"), "beyond_parent")
            .otherwise("accepted")
        )
        done = cut(now.select(*columns[:-1], outcome.alias("outcome")))
        judged = done if judged is None else judged.unionByName(done)
        later = cut(waiting.join(parents, "_parent", "left_semi"))
        if later.isEmpty():
            return judged
        if done.isEmpty():
            raise ValueError("the feeds' parents form a cycle")
        waiting = later


def _bounded(ready: DataFrame, judged: DataFrame | None, hot_rows: int) -> DataFrame:
    """`ready` with `parent_max_ack` raised by the accepted acks of each parent that come before."""
    if judged is None:
        return ready
    steps = judged.filter("outcome = 'accepted'").select(F.col("id").alias("_key"), "ord", F.col("ack").alias("_step"))
    own = ready.select("*", F.col("_parent").alias("_key"), F.lit(None).cast("bigint").alias("_step"))
    both = own.unionByName(steps, allowMissingColumns=True)
    raised = previous_best(both, ["_key"], "ord", F.col("_step"), "_reached", hot_rows).filter("id IS NOT NULL")
    return raised.withColumn("parent_max_ack", F.greatest("parent_max_ack", "_reached")).select(*ready.columns)


def apply_acks(feeds: DataFrame, checked: DataFrame) -> DataFrame:
    """The registry after the accepted acks.

    `max_ack` never falls; `last_ack` is the time of the ack that set it, and
    stays if no ack made progress.  Acks are combined per feed before any shuffle.
    """
    best = (
        checked.filter("outcome = 'accepted'")
        .groupBy("id")
        .agg(F.max("ack").alias("_ack"), F.max_by("ts", F.struct(F.col("ack"), -F.col("ord"))).alias("_at"))
    )
    progress = F.coalesce(F.col("_ack") > F.col("max_ack"), F.lit(False))
    kept: list[Column] = [F.col(c) for c in feeds.columns if c not in ("max_ack", "last_ack")]
    return (
        feeds.join(best, "id", "left")
        .select(
            *kept,
            F.greatest("max_ack", "_ack").alias("max_ack"),
            F.when(progress, F.col("_at")).otherwise(F.col("last_ack")).alias("last_ack"),
        )
        .select(*feeds.columns)
    )


def ack_progress(before: DataFrame, after: DataFrame) -> DataFrame:
    """Feeds whose position really moved: `(id, max_ack)`.  These wake their children."""
    old = before.select("id", F.col("max_ack").alias("_old"))
    return after.join(old, "id").filter(F.col("max_ack") > F.col("_old")).select("id", "max_ack")


def woken_children(feeds: DataFrame, progress: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Feeds that may read on because their parent's position moved: `(id, parent_id, bound)`.

    `progress` is rows of `ack_progress`, of one batch or of several in any order, repeated or not; the furthest
    position of a parent counts.  A child that has itself acknowledged that far sleeps on.  One parent may have most of the feeds.
    """
    moved = progress.groupBy(F.col("id").alias("parent_id")).agg(F.max("max_ack").alias("bound"))
    children = feeds.filter("parent_id IS NOT NULL").select("id", "parent_id", "max_ack")
    woken = join_unique(children, moved, ["parent_id"], hot_rows).filter("bound > max_ack")
    return woken.select("id", "parent_id", "bound")


def wake(open_cursors: DataFrame, woken: DataFrame) -> DataFrame:
    """The open cursors whose bound moves, raised to it: all that a poll after an ack needs to look at.

    A cursor that was raised as far before is left out, so rows of progress that come again wake nobody.
    """
    raised = open_cursors.join(woken.groupBy("id").agg(F.max("bound").alias("_bound")), "id")
    moved = raised.filter(F.col("_bound") > F.col("parent_max_ack"))
    return moved.withColumn("parent_max_ack", F.col("_bound")).select(*open_cursors.columns)
