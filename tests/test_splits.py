"""Tasks of the per-root search become more, not larger, as its tables grow."""

from pyspark.sql import functions as F

from tidegraph import lineage
from tidegraph.operators import closure

KEY = "spark.sql.files.maxPartitionBytes"


def test_stored_tables_are_read_in_small_splits(spark, monkeypatch):
    monkeypatch.setattr(lineage, "SPLIT_BYTES", 256 << 10)
    usual = spark.conf.get(KEY)
    rows = spark.range(0, 400_000, 1, 1).select("id", F.xxhash64("id").alias("h"))
    with lineage.small_splits(spark):
        held = lineage.settled(rows)
        counts = held.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == 400_000
    assert max(r["count"] for r in counts) < 100_000
    assert spark.conf.get(KEY) == usual


def test_the_search_per_root_uses_them(spark, monkeypatch):
    seen, usual, counted = [], spark.conf.get(KEY), closure.counted
    monkeypatch.setattr(closure, "counted", lambda df: seen.append(spark.conf.get(KEY)) or counted(df))
    links = spark.createDataFrame([("a", "1", "b", "1"), ("b", "1", "c", "1")], "src_type string, src_id string, dst_type string, dst_id string")
    roots = spark.createDataFrame([("a", "1")], "type string, id string")
    rows = closure.closure_each(links, roots).collect()
    assert sorted(map(tuple, rows)) == [("a", "1", "b", "1"), ("a", "1", "c", "1")]
    assert seen and set(seen) == {str(lineage.SPLIT_BYTES)}
    assert spark.conf.get(KEY) == usual
