"""What the operators of this package share: table reads, Arrow maps and class labels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.lineage import shared_folder

BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def remainder(column: str, by: int) -> Column:
    """crc32 of the decimal text of an id, modulo `by`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def find_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, also outside its folder.

    A cluster without a common installation gets the package by `--py-files`.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    find_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, step: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Run `step` on slices of at most `BATCH_ROWS` rows of each partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = step(pa.Table.from_batches([batch.slice(at, BATCH_ROWS)]))
                if out is not None:
                    yield from out.to_batches()

    return map_batches(df, run, schema)


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder once and read back; a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def texts_of(rows: pa.Table, column: str = "text") -> list[str]:
    return [x or "" for x in rows[column].to_pylist()]
