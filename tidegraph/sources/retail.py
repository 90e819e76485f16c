"""The star-schema tables seen as a resource graph.

Nodes are regions, nations, customers, suppliers, parts and orders.  A region
refers to its lowest nation, which makes a cycle.  A part refers to a warehouse,
a type that is never loaded, so those references dangle.  Customers and
suppliers with a negative balance are tombstones without references.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions.jsontext import identifier

EPOCH = "2024-01-01 00:00:00"


# Row shapes of the tables that are read; stating them saves a look into every file.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def text(column: str) -> Column:
    return F.col(column).cast("string")


def _edge(df: DataFrame, from_type: str, from_id: str, to_type: str, to_id: str) -> DataFrame:
    return df.select(
        F.lit(from_type).alias("from_type"),
        text(from_id).alias("from_id"),
        F.lit(to_type).alias("to_type"),
        text(to_id).alias("to_id"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all live resources.  Pairs repeat where line items do."""
    nation = table(spark, sf_dir, "nation")
    lead = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("lead"))
    customer = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    supplier = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0")
    # Line items are scanned once per reference, two columns each: plain scans, unlike
    # exploded ones, are counted from file footers when links are sized up.
    lineitem = table(spark, sf_dir, "lineitem")
    return reduce(
        DataFrame.unionByName,
        [
            _edge(lead, "region", "n_regionkey", "nation", "lead"),
            _edge(nation, "nation", "n_nationkey", "region", "n_regionkey"),
            _edge(customer, "customer", "c_custkey", "nation", "c_nationkey"),
            _edge(supplier, "supplier", "s_suppkey", "nation", "s_nationkey"),
            _edge(table(spark, sf_dir, "part"), "part", "p_partkey", "warehouse", "p_size"),
            _edge(table(spark, sf_dir, "orders"), "order", "o_orderkey", "customer", "o_custkey"),
            _edge(lineitem, "order", "l_orderkey", "part", "l_partkey"),
            _edge(lineitem, "order", "l_orderkey", "supplier", "l_suppkey"),
        ],
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(type, id, deleted, resource)`: the resource table without the references, which are in `edges`."""

    def nodes(name: str, type_: str, key: str, label: str, deleted: str = "false") -> DataFrame:
        body = F.to_json(
            F.struct(
                F.struct(F.col(label).alias("label")).alias("attributes"), text(key).alias("id"), F.lit(type_).alias("type")
            )
        )
        return table(spark, sf_dir, name).select(
            F.lit(type_).alias("type"), text(key).alias("id"), F.expr(deleted).alias("deleted"), body.alias("resource")
        )

    return reduce(
        DataFrame.unionByName,
        [
            nodes("region", "region", "r_regionkey", "r_name"),
            nodes("nation", "nation", "n_nationkey", "n_name"),
            nodes("customer", "customer", "c_custkey", "c_name", "c_acctbal < 0"),
            nodes("supplier", "supplier", "s_suppkey", "s_name", "s_acctbal < 0"),
            nodes("part", "part", "p_partkey", "p_name"),
            nodes("orders", "order", "o_orderkey", "o_orderpriority"),
        ],
    )


def lineitem_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per line item, with a single, a list, and an empty relationship."""
    one = F.struct(identifier(F.lit("order"), text("l_orderkey")).alias("data"))
    many = F.struct(
        F.array(
            identifier(F.lit("supplier"), text("l_suppkey")),
            identifier(F.lit("part"), text("l_partkey")),
            identifier(F.lit("order"), text("l_orderkey")),
        ).alias("data")
    )
    none = F.struct(F.struct(text("l_shipdate").alias("shipped")).alias("meta"))
    body = F.struct(
        F.lit("lineitem").alias("type"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.struct(F.col("l_quantity").alias("quantity")).alias("attributes"),
        F.struct(one.alias("order"), many.alias("goods"), none.alias("notes")).alias("relationships"),
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(body).alias("body"))


def event_writes(spark: SparkSession, sf_dir: str, unnumbered: Sequence[str] = ()) -> DataFrame:
    """The events as raw writes to `user/<user_id>`, with sequence `props.k`; sign-ups are deletes.

    Event types in `unnumbered` come without a sequence.
    """
    k = F.get_json_object("props", "$.k")
    item = F.struct(F.struct(identifier(F.lit("part"), k).alias("data")).alias("item"))
    user = F.struct(
        F.lit("user").alias("type"),
        text("user_id").alias("id"),
        F.struct("event_type", "value").alias("attributes"),
        item.alias("relationships"),
    )
    body = F.to_json(F.struct(user.alias("data")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", "delete").otherwise("put").alias("op"),
        F.lit("user").alias("path_type"),
        text("user_id").alias("path_id"),
        F.when(~F.col("event_type").isin(list(unnumbered)), k.cast("bigint")).alias("header_seq"),
        body.alias("body"),
    )


def customer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resource table that exists before the events: one user per customer, numbered by nation."""
    nation = identifier(F.lit("nation"), text("c_nationkey"))
    seq = F.col("c_nationkey").cast("bigint")
    body = F.to_json(
        F.struct(
            F.struct(F.col("c_mktsegment").alias("segment")).alias("attributes"),
            text("c_custkey").alias("id"),
            F.struct(seq.alias("sequenceNumber")).alias("meta"),
            F.struct(F.struct(nation.alias("data")).alias("home")).alias("relationships"),
            F.lit("user").alias("type"),
        )
    )
    stamp = F.lit(EPOCH).cast("timestamp") - F.expr("interval 1 day")
    return table(spark, sf_dir, "customer").select(
        F.lit("user").alias("type"),
        text("c_custkey").alias("id"),
        F.lit(False).alias("deleted"),
        body.alias("resource"),
        seq.alias("sequence_number"),
        stamp.alias("created"),
        stamp.alias("updated"),
        F.array(nation).alias("out_refs"),
    )


def log_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each resource changed, before compaction: `(type, id, event_time)`."""

    def seen(name: str, at: str, first: Column, second: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.inline(F.array(first, second)).alias("type", "id"), F.col(at).alias("event_time")
        )

    def node(type_: str, key: str) -> Column:
        return identifier(F.lit(type_), text(key))

    orders = seen("orders", "o_orderdate", node("order", "o_orderkey"), node("customer", "o_custkey"))
    return orders.unionByName(
        seen("lineitem", "l_shipdate", node("part", "l_partkey"), node("supplier", "l_suppkey"))
    )


def newest_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`log_updates` compacted: the latest row of each resource.

    A type comes from one key of one table, so it is grouped by that key before it becomes text.
    """

    def newest(name: str, at: str, type_: str, key: str) -> DataFrame:
        rows = table(spark, sf_dir, name).groupBy(key).agg(F.max(at).alias("event_time"))
        return rows.select(F.lit(type_).alias("type"), text(key).alias("id"), "event_time")

    return reduce(
        DataFrame.unionByName,
        [
            newest("orders", "o_orderdate", "order", "o_orderkey"),
            newest("orders", "o_orderdate", "customer", "o_custkey"),
            newest("lineitem", "l_shipdate", "part", "l_partkey"),
            newest("lineitem", "l_shipdate", "supplier", "l_suppkey"),
        ],
    )


def changefeeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of feeds: regions are roots, nations read behind them, customers behind nations.

    Customer feeds are filtered by market segment: one type, two types, no
    filter, an empty filter, or a type that never changes.
    """
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    stamp = F.lit(EPOCH).cast("timestamp")
    balance = F.floor(F.greatest("c_acctbal", F.lit(0.0))).cast("bigint")
    every = F.lit(None).cast("array<string>")

    def feeds(df: DataFrame, id_: Column, parent: Column, types: Column, max_ack: Column) -> DataFrame:
        return df.select(
            id_.alias("id"),
            parent.alias("parent_id"),
            types.alias("type_filter"),
            max_ack.alias("max_ack"),
            stamp.alias("created"),
            stamp.alias("last_ack"),
        )

    by_nation = customer.groupBy("c_nationkey").agg(F.max(balance).alias("ack"))
    nations = nation.join(by_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    regions = nations.groupBy("n_regionkey").agg(F.min("ack").alias("ack"))
    segment = F.col("c_mktsegment")
    types = (
        F.when(segment == "AUTOMOBILE", F.array(F.lit("order")))
        .when(segment == "BUILDING", F.array(F.lit("customer"), F.lit("order")))
        .when(segment == "FURNITURE", F.array().cast("array<string>"))
        .when(segment == "MACHINERY", F.array(F.lit("part"), F.lit("region")))
        .otherwise(every)
    )
    none = F.lit(None).cast("string")
    return reduce(
        DataFrame.unionByName,
        [
            feeds(regions, F.concat(F.lit("region-"), text("n_regionkey")), none, every, F.coalesce("ack", F.lit(0))),
            feeds(
                nations,
                F.concat(F.lit("nation-"), text("n_nationkey")),
                F.concat(F.lit("region-"), text("n_regionkey")),
                F.array(F.lit("order"), F.lit("supplier")),
                F.coalesce("ack", F.lit(0)),
            ),
            feeds(
                customer,
                F.concat(F.lit("customer-"), text("c_custkey")),
                F.concat(F.lit("nation-"), text("c_nationkey")),
                types,
                balance,
            ),
        ],
    )
