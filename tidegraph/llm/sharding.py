"""Sharding by minimax contiguous partition.

Groups of equal texts are atoms, ordered by their smallest doc_id (null last,
then by digest).  The shards are runs of that order, and the
largest shard is as small as any such cut allows: a binary search over shard
capacities asks of each whether filling shards greedily needs at most `shards` of them, and the groups are cut at the smallest that holds.

The order lives in Spark as running totals.  The driver sees at most `KNOTS` of
them at a time: it searches between an optimistic and a pessimistic reading of
the gaps in between, fetches finer totals for the gaps that matter, and stops when
capacity and cuts are certain.  The result is exact, whatever the size of the data.

Sizes are the UTF-8 bytes of a text, null as empty, plus 1.  Repeated rows and
repeated ids are rows of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.lineage import cut
from tidegraph.llm.base import utf8
from tidegraph.operators.ordering import with_sequence
from tidegraph.skew import join_unique

KNOTS = 1 << 15


class Totals:
    """Running totals of the groups, as far as fetched; `hidden[i]` tells of unseen ones between i - 1 and i."""

    def __init__(self, ends: np.ndarray, hidden: np.ndarray) -> None:
        self.ends, self.hidden = np.append(0, ends), np.append(False, hidden)

    def reach(self, start: int, capacity: int) -> tuple[int, int, int]:
        """The largest total up to start + capacity, at least and at most, and its gap (0: none)."""
        limit = start + capacity
        at = int(np.searchsorted(self.ends, limit, side="right"))
        least = int(self.ends[at - 1])
        if at == len(self.ends) or not self.hidden[at]:
            return least, least, 0
        return least, min(limit, int(self.ends[at]) - 1), at

    def fill(self, capacity: int, shards: int, hopeful: bool) -> tuple[list[int], set[int]]:
        """Where the shards end that are filled greedily, read hopefully or not, and the gaps met."""
        ends, gaps, start = [], set(), 0
        for _ in range(shards):
            least, most, gap = self.reach(start, capacity)
            gaps.add(gap)
            start = max(start, most if hopeful else least)
            ends.append(start)
        return ends, gaps - {0}

    def smallest(self, low: int, shards: int, hopeful: bool) -> int:
        """The smallest capacity from `low` on that holds all groups."""
        total = int(self.ends[-1])
        high = max(low, total)
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, hopeful)[0][-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low


def _fetch(groups: DataFrame, bucket: Column) -> tuple[np.ndarray, np.ndarray]:
    """The last total of each bucket, in order, and whether the bucket holds more than one."""
    rows = groups.groupBy(bucket.alias("_bucket")).agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).collect()
    found = np.array(sorted((r.end, r.n > 1) for r in rows), dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1].astype(bool)


def cuts(groups: DataFrame, shards: int, knots: int = KNOTS) -> tuple[int, list[int]]:
    """The smallest capacity, and the running total at which each shard ends.

    `groups` holds `end`, the running total of sizes up to and including each group, and `size`.
    """
    top = groups.agg(F.max("end").alias("total"), F.max("size").alias("largest")).first()
    if top.total is None:
        return 0, [0] * shards
    total, low = top.total, max(top.largest, -(-top.total // shards))
    width = max(1, -(-total // knots))
    known = Totals(*_fetch(groups, F.floor((F.col("end") - 1) / width)))
    while True:
        floor = known.smallest(low, shards, hopeful=True)
        ceiling = known.smallest(floor, shards, hopeful=False)
        doubtful = known.fill(floor, shards, True)[1] | known.fill(ceiling, shards, False)[1]
        for a, b in zip(known.fill(floor, shards, False)[0], known.fill(ceiling, shards, True)[0], strict=True):
            first, last = np.searchsorted(known.ends, [a, b], side="left")
            doubtful |= {g for g in range(int(first), min(int(last) + 2, len(known.ends))) if known.hidden[g]}
        if floor == ceiling and not (known.fill(floor, shards, True)[1] | known.fill(floor, shards, False)[1]):
            return floor, known.fill(floor, shards, False)[0]
        known, width = _refined(groups, known, sorted(doubtful), knots, width)


def _refined(groups: DataFrame, known: Totals, gaps: list[int], knots: int, width: int) -> tuple[Totals, int]:
    """`known` with finer totals inside `gaps`, and their width; neighbouring gaps make one span, and all spans share the knots."""
    spans: list[list[int]] = []
    for gap in gaps:
        left, right = int(known.ends[gap - 1]), int(known.ends[gap])
        if spans and spans[-1][1] == left:
            spans[-1][1] = right
        else:
            spans.append([left, right])
    width = max(1, min(-(-sum(b - a for a, b in spans) // knots), width // 2))  # halved at least, so this comes to an end
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | ((F.col("end") > a) & (F.col("end") <= b))
    fresh, hidden = _fetch(groups.filter(inside), F.struct(F.floor((F.col("end") - 1) / width), *(F.col("end") > b for _, b in spans)))
    # A bucket can begin before a span that it only overlaps, so what is hidden counts from the known total before it.
    keep = np.ones(len(known.ends), bool)
    keep[gaps], keep[0] = False, False
    ends, flags = np.append(known.ends[keep], fresh), np.append(known.hidden[keep], hidden)
    order = np.argsort(ends, kind="stable")
    return Totals(ends[order], flags[order]), width


def grouped(documents: DataFrame) -> DataFrame:
    """Per row doc_id, size, text_crc32 and the digest of the text that its group shares."""
    data = utf8("text")
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.unhex(F.sha2(data, 256)).alias("_text"),
    )


def shard_rows(documents: DataFrame, shards: int = 8, knots: int = KNOTS) -> DataFrame:
    """Per row of `documents`: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = cut(grouped(documents))
    groups = rows.groupBy("_text").agg(F.sum("size").alias("size"), F.min("doc_id").alias("_first"))
    groups = _running(groups.withColumn("_none", F.col("_first").isNull()), ["_none", "_first", "_text"])
    _, ends = cuts(groups, shards, knots)
    shard = F.lit(0)
    for end in ends[:-1]:
        shard = shard + (F.col("end") > end).cast("int")
    placed = join_unique(rows, groups.select("_text", "end", shard.alias("shard")), ["_text"])
    numbered = with_sequence(placed, ["shard", "end", "doc_id"], "_number")
    firsts = numbered.groupBy("shard").agg(F.min("_number").alias("_start"))  # a row per shard
    return numbered.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_number") - F.col("_start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _running(groups: DataFrame, order: list[str]) -> DataFrame:
    """`groups` with `end`, the running total of `size` in `order`: per range, plus the totals of the ranges before."""
    ranged = cut(groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut(
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn("end", F.col("_offset") + F.sum("size").over(within))
        .select(*groups.columns, "end")
    )
