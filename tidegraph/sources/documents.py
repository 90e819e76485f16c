"""Ingest of resource documents: raw JSON writes to write rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.jsontext import IDENTIFIERS, identifiers, member, member_doc, parsed, string_member
from tidegraph.schema import RAW_BATCHES, READ_WRITES, UNREADABLE


def _located(lines: DataFrame) -> DataFrame:
    return lines.withColumn("file", F.col("_metadata.file_path"))


def read_writes(spark: SparkSession, path: str) -> DataFrame:
    """Raw writes, one JSON object a line, with `file` and, for a line that is none, its text in `unreadable`."""
    return _located(spark.read.schema(READ_WRITES).option("columnNameOfCorruptRecord", UNREADABLE).json(path))


def stream_writes(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw writes as a stream; `files_per_batch` is the pacing of the propagation job."""
    lines = spark.readStream.schema(READ_WRITES).option("columnNameOfCorruptRecord", UNREADABLE)
    return _located(lines.option("maxFilesPerTrigger", files_per_batch).json(path))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_BATCHES).json(path)


def _given(text: Column) -> Column:
    """A member that is present and not JSON null."""
    return F.when(text != "null", text)


def _whole_number(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def normalise(raw: DataFrame) -> DataFrame:
    """Raw writes `{"data": {...}}` as write rows, other columns kept.

    The header sequence overrides the one in `meta`.  A delete keeps only the
    identifier and the sequence, and never has references.  Adds `body_type`
    and `body_id`, which validation compares with the path.
    """
    # Only puts carry content; parsing is skipped for deletes but for their sequence.
    put, doc = F.col("op") != "delete", F.col("_doc")
    parts = raw.withColumn("_doc", member_doc(parsed(F.col("body")), "data")).drop("body")
    parts = parts.select(
        *[c for c in parts.columns if c != "_doc"],
        string_member(doc, "type").alias("body_type"),
        string_member(doc, "id").alias("body_id"),
        F.coalesce("header_seq", _whole_number(member_doc(doc, "meta.sequenceNumber"))).alias("seq"),
        F.when(put, _given(member(doc, "attributes"))).alias("attributes"),
        F.when(put, _given(member(doc, "relationships"))).alias("relationships"),
        F.when(put, member_doc(doc, "relationships")).alias("_relationships"),
        F.when(put, _given(member(doc, "links"))).alias("links"),
        _given(member(doc, "meta")).isNotNull().alias("_has_meta"),
    )
    return parts.select(
        *[c for c in parts.columns if c not in ("_has_meta", "header_seq", "links", "_relationships")],
        F.col("path_type").alias("type"),
        F.col("path_id").alias("id"),
        (~put).alias("deleted"),
        _body(F.col("path_type"), F.col("path_id")).alias("body"),
        F.when(put, identifiers(F.col("_relationships")))
        .otherwise(F.array().cast(IDENTIFIERS))
        .alias("out_refs"),
    )


def _body(type_: Column, id_: Column) -> Column:
    """The stored document, members in canonical order, absent ones left out."""

    def part(name: str, text: Column) -> Column:
        return F.when(text.isNotNull(), F.concat(F.lit(f'"{name}":'), text))

    def quoted(value: Column) -> Column:
        text = F.to_json(F.struct(value.alias("v")))  # cut by place, as an id may hold any character
        return F.substring(text, F.lit(6), F.length(text) - 6)

    meta = F.when(
        F.col("seq").isNotNull(), F.concat(F.lit('{"sequenceNumber":'), F.col("seq").cast("string"), F.lit("}"))
    ).when(F.col("_has_meta"), F.lit("{}"))
    members = F.concat_ws(
        ",",
        part("attributes", F.col("attributes")),
        part("id", quoted(id_)),
        part("links", F.col("links")),
        part("meta", meta),
        part("relationships", F.col("relationships")),
        part("type", quoted(type_)),
    )
    return F.concat(F.lit("{"), members, F.lit("}"))


def explode_batches(batches: DataFrame) -> DataFrame:
    """One raw write per element of `data`, with its position: `(batch_id, pos, ...)`."""
    items = F.from_json("body", "struct<data:array<string>>")["data"]
    return batches.select("batch_id", "ts", F.posexplode(items).alias("pos", "item")).select(
        "batch_id",
        "pos",
        "ts",
        F.lit("put").alias("op"),
        F.get_json_object("item", "$.type").alias("path_type"),
        F.get_json_object("item", "$.id").alias("path_id"),
        F.lit(None).cast("bigint").alias("header_seq"),
        F.concat(F.lit('{"data":'), F.col("item"), F.lit("}")).alias("body"),
    )
