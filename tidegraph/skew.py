"""Finding the keys that are too heavy for one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.lineage import cut

# A key is hot above this many rows; and never more than MAX_HOT_KEYS keys are
# hot, because the bar rises to total / MAX_HOT_KEYS.  That bounds every
# broadcast of a hot-key table, whatever the size of the data.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000


@dataclass(frozen=True)
class KeyLoad:
    """Row count of a table and, if some keys are hot, the table of those keys."""

    rows: int
    hot: DataFrame | None


def key_load(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> KeyLoad:
    """Count the rows, then, unless the whole table is too small for a hot key, the rows per key.

    Reads only the key columns, combines on the map side, and brings two
    numbers to the driver.
    """
    total = df.select(*keys).count()
    bar = max(hot_rows, total // MAX_HOT_KEYS)
    if total <= bar:
        return KeyLoad(total, None)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    heaviest = counts.agg(F.max("rows")).first()[0]
    return KeyLoad(total, counts.filter(F.col("rows") > bar).select(*keys) if heaviest > bar else None)


def partitions_for(rows: int, shuffle_partitions: int) -> int:
    """Partitions for a table of `rows` narrow rows.

    About 2 million rows per task at scale; small tables use fewer tasks than
    `shuffle_partitions`, because 50,000 rows are not worth a task of their own.
    """
    small = -(-rows // 50_000)
    large = -(-rows // 2_000_000)
    return max(1, large, min(shuffle_partitions, small))


def by_rows(df: DataFrame, rows: int, most: int = MAX_HOT_KEYS) -> DataFrame:
    """`df` as one side of a join: broadcast if it has at most `most` rows, and otherwise never.

    Left alone, the planner broadcasts what is small as a file.  Narrow keys take a byte or two there and a hundred or
    more in a hash table, which the driver builds; adaptive planning does not take such a choice back.
    """
    return F.broadcast(df) if rows <= most else df.hint("merge")


def join_unique(facts: DataFrame, unique: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of a table that may have hot keys with one that has a row per key.

    Adaptive planning splits a skewed join only if nothing after it relies on
    its partitioning.  Here the rows of hot keys meet a broadcast of their
    partners, at most one for each of `MAX_HOT_KEYS` keys.
    """
    hot = key_load(facts, keys, hot_rows).hot
    if hot is None:
        return facts.join(unique, keys, "left")
    hot = cut(hot)
    partners = unique.join(F.broadcast(hot), keys, "left_semi")
    cold = facts.join(F.broadcast(hot), keys, "left_anti").join(unique, keys, "left")
    heavy = facts.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(partners), keys, "left")
    return cold.unionByName(heavy)
