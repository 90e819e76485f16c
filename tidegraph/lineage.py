"""Cutting lineage through the shared checkpoint folder.

Iterative operators materialise one table per round.  It goes to the reliable
checkpoint folder of the session, so losing an executor costs a re-read and not
a replay of every earlier round.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# Narrow rows take a few bytes each in a stored table, so a task that reads the usual 128 MB of one joins and
# combines tens of millions of them.  This much keeps a task's hash table to a few hundred MB at any size of input.
SPLIT_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: `spark.checkpoint.dir`, or a fresh local one in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="tidegraph-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably and return it with its lineage dropped."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """Materialise `df` as a Parquet table in the checkpoint folder and return that.

    Unlike a checkpoint, the table has the size it has.  A checkpoint keeps the size that the
    planner guessed, and where rounds join a table with itself the guesses multiply without bound.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4()}"
    df.write.option("compression", "zstd").option("parquet.block.size", str(SPLIT_BYTES)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`df` settled, and how many rows it has."""
    seen = Observation()
    held = settled(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return held, seen.get["rows"]


@contextmanager
def fixed_partitioning(spark: SparkSession, partitions: int):
    """Plan with a fixed number of hash partitions.

    A table cut in here keeps its hash partitioning and sort order as plan
    properties, so later rounds join and aggregate it in place.  Adaptive
    coalescing would drop both.
    """
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    with _conf(spark, wanted):
        yield


@contextmanager
def small_splits(spark: SparkSession):
    """Read files in splits of at most `SPLIT_BYTES`, so that tasks become more and not larger as tables grow."""
    with _conf(spark, {"spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES)}):
        yield


@contextmanager
def _conf(spark: SparkSession, wanted: dict[str, str]):
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
