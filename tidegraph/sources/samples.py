"""Documents, requests and queues derived from the driver tables, one per row or more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.jsontext import identifier
from tidegraph.operators.ordering import with_sequence
from tidegraph.sources.retail import newest_updates, table, text


def event_k() -> Column:
    return F.get_json_object("props", "$.k")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted change log of the tables, numbered by time, then type, then id."""
    return with_sequence(newest_updates(spark, sf_dir), ["event_time", "type", "id"], "seq")


def queued_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a queued change: purchases of the customer, other events of a part."""
    bought = F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"),
        F.when(bought, "customer").otherwise("part").alias("type"),
        F.when(bought, text("user_id")).otherwise(event_k()).alias("id"),
    )


def feed_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an ack of the user's feed."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("customer-"), text("user_id")).alias("id"),
        (event_k().cast("bigint") * 100).alias("ack"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def parent_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an ack of a feed with children: purchases of a region's, other events of a nation's."""
    bought = F.col("event_type") == "purchase"
    region = F.concat(F.lit("region-"), (F.col("user_id") % 5).cast("string"))
    nation = F.concat(F.lit("nation-"), (F.col("user_id") % 25).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.when(bought, region).otherwise(nation).alias("id"),
        (event_k().cast("bigint") * 100).alias("ack"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def create_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers asking for a feed of their nation: some repeat, some exist, some name no known parent."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"),
        F.concat(F.when(F.col("s_acctbal") < 0, "nation-").otherwise("site-"), text("s_nationkey")).alias("id"),
        F.lit(None).cast("array<string>").alias("type_filter"),
        F.concat(F.lit("region-"), text("s_nationkey")).alias("parent_id"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("ts"),
    )


def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of tombstoned customers, feeds with children, and feeds that never were."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return (
        customer.filter("c_acctbal < 0")
        .select(F.col("c_custkey").alias("ord"), F.concat(F.lit("customer-"), text("c_custkey")).alias("id"))
        .unionByName(
            customer.select((F.col("c_custkey") + 10**10).alias("ord"), F.concat(F.lit("nation-"), text("c_nationkey")).alias("id"))
        )
        .unionByName(
            supplier.select((F.col("s_suppkey") + 2 * 10**10).alias("ord"), F.concat(F.lit("supplier-"), text("s_suppkey")).alias("id"))
        )
    )


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per event, `{"data": ...}`; four of the five event types break a rule."""
    kind = F.col("event_type")

    def doc(id_: Column, attributes: Column, relationships: Column) -> Column:
        return F.to_json(
            F.struct(
                F.struct(
                    F.lit("user").alias("type"),
                    id_.alias("id"),
                    attributes.alias("attributes"),
                    relationships.alias("relationships"),
                ).alias("data")
            )
        )

    user, item = text("user_id"), F.struct(identifier(F.lit("part"), event_k()).alias("data"))
    plain = F.struct(F.col("value"))
    body = (
        F.when(kind == "view", doc(user, F.struct(F.col("value").alias("item")), F.struct(item.alias("item"))))
        .when(kind == "signup", doc(user, F.struct(F.array(F.struct(F.col("value").alias("links"))).alias("trail")), F.struct(item.alias("item"))))
        .when(kind == "error", doc(F.lit(None).cast("string"), plain, F.struct(item.alias("item"))))
        .when(kind == "purchase", doc(F.when(F.col("value") < 20, user).otherwise(event_k()), plain, F.struct(F.struct(F.array(item["data"], item["data"]).alias("data")).alias("items"))))
        .otherwise(doc(user, plain, F.struct(F.struct(F.struct(F.lit("part").alias("type")).alias("data")).alias("item"))))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("put").alias("op"),
        F.lit("user").alias("path_type"),
        user.alias("path_id"),
        F.lit(None).cast("bigint").alias("header_seq"),
        body.alias("body"),
    )


def write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event as a client might send it: cut off, without `op`, with an unknown one, with a wrong `ord`, or right."""
    kind = F.col("event_type")
    place = F.when(kind == "purchase", F.concat(F.lit('"'), text("event_id"), F.lit('"'))).otherwise(text("event_id"))
    op = F.when(kind == "signup", "").when(kind == "error", '"op":"patch",').otherwise('"op":"put",')
    named = F.concat(F.lit('"path_type":"user","path_id":"'), text("user_id"), F.lit('"'))
    body = F.concat(F.lit(r',"body":"{\"data\":{\"type\":\"user\",\"id\":\"'), text("user_id"), F.lit(r'\"}}"'))
    end = F.when(kind == "view", "").otherwise("}")
    line = F.concat(F.lit('{"ord":'), place, F.lit(","), op, named, body, end)
    return table(spark, sf_dir, "events").select("event_id", line.alias("value"))


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a resource; French ones hold it under a member that attributes may not have."""
    member = F.when(F.col("lang") == "fr", F.lit("links")).otherwise(F.col("lang"))
    passages = F.array(F.create_map(member, F.col("text")))
    body = F.struct(
        F.col("source").alias("type"),
        text("doc_id").alias("id"),
        F.struct(passages.alias("passages"), F.col("lang").alias("title")).alias("attributes"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(body).alias("body"))


def changefeed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changefeed document per customer; three of five segments break a rule."""
    segment = F.col("c_mktsegment")
    types = (
        F.when(segment == "AUTOMOBILE", F.lit('"typeFilter":["order","part"]'))
        .when(segment == "BUILDING", F.lit('"typeFilter":123'))
        .when(segment == "FURNITURE", F.lit('"typeFilter":["order",7]'))
        .otherwise(F.lit(""))
    )
    parent_type = F.when(segment == "MACHINERY", "nation").otherwise("changefeed")
    body = F.concat(
        F.lit('{"type":"changefeed","id":"customer-'),
        text("c_custkey"),
        F.lit('","attributes":{'),
        types,
        F.lit('},"relationships":{"parent":{"data":{"type":"'),
        parent_type,
        F.lit('","id":"nation-'),
        text("c_nationkey"),
        F.lit('"}}}}'),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"))


def lineitem_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch document per line item, writing its supplier, its part and its order."""
    def bare(type_: str, key: str) -> Column:
        return identifier(F.lit(type_), text(key))

    data = F.array(bare("supplier", "l_suppkey"), bare("part", "l_partkey"), bare("order", "l_orderkey"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("batch_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.to_json(F.struct(data.alias("data"))).alias("body"),
    )


def order_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as items of one batch per order, keyed by part; an order may name a part twice."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"), F.lit("part").alias("type"), text("l_partkey").alias("id")
    )
