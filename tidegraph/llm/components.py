"""Connected components of a link table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the least node it is linked to over any path.

    Every round takes the least label among a node and its neighbours, then
    the label of that label, so long chains fold up in a few rounds.  Rounds are
    cut to the checkpoint folder; the driver sees one count per round.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    edges = cut(both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = cut(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        seen = edges.join(labels.withColumnsRenamed({"node": "other", "component": "_seen"}), "other")
        least = seen.groupBy("node").agg(F.min("_seen").alias("_seen"))
        lower = labels.join(least, "node").select(
            "node", F.col("component").alias("_was"), F.least("component", "_seen").alias("_next")
        )
        jump = lower.select(F.col("node").alias("_next"), F.col("_next").alias("_jump"))
        moved = cut(lower.join(jump, "_next").select("node", "_was", F.col("_jump").alias("component")))
        changed = moved.filter("_was <> component").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
