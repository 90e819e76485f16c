"""Versioned tables that are published together.

A store has one writer; the log (resources, edges, history) and the feed
registry are separate stores.  Each table is split into hash buckets.  A batch writes new versions of the
buckets it touches and leaves all others; one manifest file, written last, names
the version of every bucket, the number of buckets and the last batch of every writer.  Readers see the
state of the newest manifest, found by its folder's name.  A batch that failed halfway left no manifest and is
written again under the same version; one that is published is known by its writer and number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.operators.closure import TableLinks
from tidegraph.schema import CHANGEFEEDS, EDGES, HISTORY, NODE, RESOURCES

# Table, its row shape, and the columns its buckets are hashed by.  Edges are
# bucketed by target, the side on which changes arrive.
TABLES = {
    "resources": (RESOURCES, ["type", "id"]),
    "edges": (EDGES, ["to_type", "to_id"]),
    "history": (HISTORY, ["type", "id"]),
    "changefeeds": (CHANGEFEEDS, ["id"]),
}

MANIFEST = (
    "table string, bucket int, version bigint, max_seq bigint, buckets int, writer string, batch_id bigint"
)


@dataclass(frozen=True)
class SnapshotStore:
    """`buckets` counts when the store is founded; afterwards the store knows its own number."""

    spark: SparkSession
    root: str
    buckets: int = 64

    @cached_property
    def width(self) -> int:
        newest = self._newest()
        return self.buckets if newest is None else newest.first()["buckets"]

    def bucket_of(self, table: str, columns: list[str] | None = None) -> Column:
        """The bucket of a key, held in the columns of that table or in those given."""
        return F.pmod(F.xxhash64(*(columns or TABLES[table][1])), F.lit(self.width)).cast("int")

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets that hold the given keys: at most `buckets` numbers."""
        return [r[0] for r in keys.select(self.bucket_of(table)).distinct().collect()]

    # Manifests ---------------------------------------------------------------

    def last_version(self) -> int | None:
        """The newest published version, from the names of the manifests alone."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        found = []
        for status in files.listStatus(folder):
            path = status.getPath()
            if files.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                found.append(int(path.getName().partition("=")[2]))
        return max(found, default=None)

    def next_version(self) -> int:
        last = self.last_version()
        return 0 if last is None else last + 1

    def _newest(self) -> DataFrame | None:
        last = self.last_version()
        if last is None:
            return None
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/version={last}")

    def max_seq(self) -> int:
        """The high-water mark of the log, from the newest manifest."""
        newest = self._newest()
        return 0 if newest is None else (newest.agg(F.max("max_seq")).first()[0] or 0)

    def high_water_marks(self) -> DataFrame:
        """Versions that moved the high-water mark: `(version, max_seq)`."""
        if self.last_version() is None:
            return self.spark.createDataFrame([], "version bigint, max_seq bigint")
        heads = self.spark.read.schema("max_seq bigint, version int").json(f"{self.root}/manifest")
        return heads.groupBy("max_seq").agg(F.min("version").cast("bigint").alias("version")).select("version", "max_seq")

    def versions(self) -> dict[str, dict[int, int]]:
        """Table to bucket to version; a few thousand entries at most."""
        found: dict[str, dict[int, int]] = {name: {} for name in TABLES}
        newest = self._newest()
        for row in newest.collect() if newest is not None else []:
            if row["table"] is not None:
                found[row["table"]][row["bucket"]] = row["version"]
        return found

    # Tables ------------------------------------------------------------------

    def read(self, table: str, buckets: list[int] | None = None, versions: dict | None = None) -> DataFrame:
        """The published rows of a table, or of some of its buckets, with the column `bucket`."""
        current = (self.versions() if versions is None else versions)[table]
        paths = [
            f"{self.root}/{table}/version={version}/bucket={bucket}"
            for bucket, version in sorted(current.items())
            if buckets is None or bucket in buckets
        ]
        schema = T.StructType([*TABLES[table][0].fields, T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        return read.parquet(*paths).select(*schema.fieldNames())

    def stage(self, table: str, rows: DataFrame, touched: list[int], version: int, sort: list[str]) -> dict[int, int | None]:
        """Write new versions of the touched buckets; a bucket left empty gets the version None."""
        path = f"{self.root}/{table}/version={version}"
        columns = TABLES[table][0].fieldNames()
        (
            rows.select(*columns, self.bucket_of(table).alias("bucket"))
            # Splits large buckets over several tasks and joins small ones, by measured size.
            .hint("rebalance", F.col("bucket"))
            .sortWithinPartitions("bucket", *sort)
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(path)
        )
        schema = T.StructType([*TABLES[table][0].fields, T.StructField("bucket", T.IntegerType())])
        filled = {r[0] for r in self.spark.read.schema(schema).parquet(path).select("bucket").distinct().collect()}
        return {bucket: version if bucket in filled else None for bucket in touched}

    def done(self, writer: str, batch_id: int) -> bool:
        """Whether this writer's batch is published already, as after a restart."""
        newest = self._newest()
        last = None if newest is None else newest.filter(F.col("writer") == writer).agg(F.max("batch_id")).first()[0]
        return last is not None and batch_id <= last

    def publish(
        self,
        version: int,
        staged: dict[str, dict[int, int | None]],
        max_seq: int,
        done: dict[str, int] | None = None,
    ) -> None:
        """Make the staged buckets current.  One file, moved into place in one step."""
        newest, current = self._newest(), self.versions()
        known = [] if newest is None else newest.filter("writer IS NOT NULL").select("writer", "batch_id").collect()
        last = {r.writer: r.batch_id for r in known} | (done or {})
        rows: list[tuple] = [(None, None, None, max_seq, self.width, None, None)]
        rows += [(None, None, None, max_seq, self.width, writer, batch) for writer, batch in last.items()]
        for table, known_versions in current.items():
            merged = {**known_versions, **staged.get(table, {})}
            rows += [(table, b, v, max_seq, self.width, None, None) for b, v in merged.items() if v is not None]
        manifest = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.root}/manifest/version={version}")

    def links_against_edges(self, versions: dict | None = None) -> TableLinks:
        """From a resource to its referrers, read from the stored edges."""
        links = self.read("edges", versions=versions).select(
            F.col("to_type").alias("type"),
            F.col("to_id").alias("id"),
            F.col("from_type").alias("dst_type"),
            F.col("from_id").alias("dst_id"),
            "bucket",
        )
        return TableLinks(links, self.bucket_of("edges", NODE))

    def links_along_edges(self, versions: dict | None = None) -> TableLinks:
        """From a live resource to what it refers to, read from the stored resources."""
        live = self.read("resources", versions=versions).filter(~F.col("deleted"))
        links = live.select(*NODE, F.explode("out_refs").alias("ref"), "bucket").select(
            *NODE, F.col("ref.type").alias("dst_type"), F.col("ref.id").alias("dst_id"), "bucket"
        )
        return TableLinks(links, self.bucket_of("resources", NODE))

    # Append-only outputs -------------------------------------------------------

    def append(self, output: str, rows: DataFrame, version: int) -> None:
        """Rows of one batch of an append-only output; a replay replaces them."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{output}/batch={version}")

    def output(self, output: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{output}")
