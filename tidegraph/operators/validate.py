"""Checks on incoming documents and batches, as columns and verdict tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.jsontext import (
    member,
    member_doc,
    parsed,
    string_member,
)
from tidegraph.lineage import cut
from tidegraph.schema import NODE, RAW_WRITES, UNREADABLE

MAX_BATCH = 10_000


def _is_text(member_text: Column) -> Column:
    return F.coalesce(member_text.startswith('"'), F.lit(False))


def _keys(object_text: Column) -> Column:
    return F.coalesce(F.json_object_keys(object_text), F.array().cast("array<string>"))


def _kind(value: Column, kind: str) -> Column:
    """Whether a variant is of a kind: OBJECT, ARRAY, STRING, BIGINT (any whole number) or VOID (JSON null)."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _absent(value: Column) -> Column:
    return value.isNull() | _kind(value, "VOID")


def _bad_relationship(doc: Column) -> Column:
    """True unless `relationships` is an object of objects whose `data` is an identifier or a list of them."""

    def good_id(value: Column) -> Column:
        return _kind(value, "OBJECT") & _kind(member_doc(value, "type"), "STRING") & _kind(member_doc(value, "id"), "STRING")

    def good(value: Column) -> Column:
        data = member_doc(value, "data")
        listed = F.forall(F.try_variant_get(data, "$", "array<variant>"), good_id)
        listed = _kind(data, "ARRAY") & F.coalesce(listed, F.lit(False))
        return _kind(value, "OBJECT") & (_absent(data) | good_id(data) | listed)

    held = member_doc(doc, "relationships")
    members = F.map_values(F.try_variant_get(held, "$", "map<string,variant>"))
    return ~_absent(held) & ~F.coalesce(F.forall(members, good), F.lit(False))


# In canonical text a member name follows `{` or `,` directly; inside a string a
# quote is escaped, so the pattern cannot match there.
RESERVED_MEMBER = r'[{,]"(links|relationships)":'


OPERATIONS = ["put", "delete"]


def document_fault(doc: Column) -> Column:
    """Why a resource document (parsed) is invalid, or NULL.

    `malformed`: no JSON object.  `identifier`: `type` or `id` missing or no string.
    `relationship`: `relationships` or one of them is no object, or a `data` is neither an identifier,
    with a string as type and id, nor a list of them.
    `attributes`: no object.  `sequence`: `meta.sequenceNumber` is no whole number.
    `reserved_name`: a member of attributes or relationships named `type` or `id`.
    `shared_name`: the same name in attributes and relationships.
    `nested_member`: `links` or `relationships` at any depth inside attributes.
    """
    attributes, relationships = member(doc, "attributes"), member(doc, "relationships")
    names, related = _keys(attributes), _keys(relationships)
    given_seq = member_doc(doc, "meta.sequenceNumber")
    reserved = F.array(F.lit("type"), F.lit("id"))
    return (
        F.when(~F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)), "malformed")
        .when(~(_is_text(member(doc, "type")) & _is_text(member(doc, "id"))), "identifier")
        .when(_bad_relationship(doc), "relationship")
        .when(~_absent(member_doc(doc, "attributes")) & ~_kind(member_doc(doc, "attributes"), "OBJECT"), "attributes")
        .when(~_absent(given_seq) & ~_kind(given_seq, "BIGINT"), "sequence")
        .when(F.arrays_overlap(F.concat(names, related), reserved), "reserved_name")
        .when(F.arrays_overlap(names, related), "shared_name")
        .when(F.coalesce(attributes.rlike(RESERVED_MEMBER), F.lit(False)), "nested_member")
    )


def path_fault(path_type: Column, path_id: Column, body_type: Column, body_id: Column) -> Column:
    """`unprocessable` if the document is not the one the path names, else NULL."""
    same = path_type.eqNullSafe(body_type) & path_id.eqNullSafe(body_id)
    return F.when(~same, "unprocessable")


def changefeed_fault(doc: Column) -> Column:
    """Why a changefeed document (parsed) is invalid, or NULL.

    `malformed`, `type` or `identifier` wrong, `parent_type` wrong, or a
    `type_filter` that is no list of strings.
    """
    parent_type = string_member(doc, "relationships.parent.data.type")
    given = member_doc(doc, "attributes.typeFilter")
    items = F.try_variant_get(doc, "$.attributes.typeFilter", "array<variant>")
    all_text = F.forall(items, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return (
        F.when(doc.isNull(), "malformed")
        .when(~F.coalesce(string_member(doc, "type") == "changefeed", F.lit(False)), "type")
        .when(~_is_text(member(doc, "id")), "identifier")
        .when(
            member_doc(doc, "relationships.parent").isNotNull()
            & ~F.coalesce(parent_type == "changefeed", F.lit(False)),
            "parent_type",
        )
        .when(F.coalesce(F.to_json(given) != "null", F.lit(False)) & ~F.coalesce(all_text, F.lit(False)), "type_filter")
    )


def batch_verdicts(items: DataFrame, max_items: int = MAX_BATCH) -> DataFrame:
    """One verdict per batch: `(batch_id, items, verdict)`.

    A batch is `too_large` above `max_items`, `unprocessable` if it names a key
    twice, else `ok`.  Keys are counted before batches, both with map-side
    combine, so a batch of any size costs no more than its distinct keys.
    """
    per_key = items.groupBy("batch_id", *NODE).agg(F.count(F.lit(1)).alias("times"))
    per_batch = per_key.groupBy("batch_id").agg(F.sum("times").alias("items"), F.max("times").alias("most"))
    verdict = (
        F.when(F.col("items") > max_items, "too_large").when(F.col("most") > 1, "unprocessable").otherwise("ok")
    )
    return per_batch.select("batch_id", "items", verdict.alias("verdict"))


def accepted_items(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The items of accepted batches.  A rejected batch is rejected whole."""
    refused = verdicts.filter("verdict <> 'ok'").select("batch_id")
    return items.join(refused, "batch_id", "left_anti")


def unreadable(rows: DataFrame) -> Column:
    """Whether a row is no write at all: its line could not be read, or it lacks a place, a path or a known `op`."""
    known = F.coalesce(F.col("op").isin(OPERATIONS), F.lit(False))
    broken = ~known | F.col("ord").isNull() | F.col("path_type").isNull() | F.col("path_id").isNull()
    return broken | F.col(UNREADABLE).isNotNull() if UNREADABLE in rows.columns else broken


def split_writes(raw: DataFrame, normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted write rows and `rejected(ord, reason, pointer, detail)`.

    `raw` has the document under `{"data": ...}`, `normalised` the write rows;
    both are keyed by `ord`.  Deletes have no document to check.  A row that is no write is `malformed`; its `detail`
    holds the file, if known, and the text of the line, and it takes no other row with it, whatever its `ord`.  The verdicts
    are cut: both results need them, and a filter on a verdict would otherwise
    be pushed down and evaluate all of it again.
    """
    doc, broken = F.col("_doc"), unreadable(raw)
    fault = F.coalesce(
        document_fault(doc),
        path_fault(F.col("path_type"), F.col("path_id"), string_member(doc, "type"), string_member(doc, "id")),
    )
    line = F.to_json(F.struct(*(c for c in RAW_WRITES.fieldNames() if c in raw.columns)))
    text = F.coalesce(UNREADABLE, line) if UNREADABLE in raw.columns else line
    file = F.col("file") if "file" in raw.columns else F.lit(None).cast("string")
    path = F.struct(F.col("path_type").alias("type"), F.col("path_id").alias("id"))
    checked = raw.withColumn("_doc", member_doc(parsed(F.col("body")), "data")).select(
        "ord",
        F.when(broken, "malformed").otherwise(F.when(F.col("op") != "delete", fault)).alias("reason"),
        F.when(broken, F.to_json(F.struct(file.alias("file"), text.alias("text")))).otherwise(F.to_json(path)).alias("detail"),
        broken.alias("_broken"),
    )
    faulty = cut(checked).filter("reason is not null")
    rejected = faulty.select("ord", "reason", F.when(F.col("_broken"), "").otherwise("/data").alias("pointer"), "detail")
    readable = normalised.filter(~unreadable(normalised)).drop(UNREADABLE, "file")
    return readable.join(faulty.filter("NOT _broken").select("ord"), "ord", "left_anti"), rejected
