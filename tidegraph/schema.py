"""Row shapes shared by all operators."""

from pyspark.sql import types as T

NODE = ["type", "id"]

IDENTIFIER = T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.StringType())])

RESOURCES = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("resource", T.StringType()),
        T.StructField("sequence_number", T.LongType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("updated", T.TimestampType()),
        T.StructField("out_refs", T.ArrayType(IDENTIFIER)),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("from_type", T.StringType()),
        T.StructField("from_id", T.StringType()),
        T.StructField("to_type", T.StringType()),
        T.StructField("to_id", T.StringType()),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
    ]
)

CHANGEFEEDS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("type_filter", T.ArrayType(T.StringType())),
        T.StructField("max_ack", T.LongType()),
        T.StructField("created", T.TimestampType()),
        T.StructField("last_ack", T.TimestampType()),
    ]
)

# One incoming write as it arrives: the path it was sent to, an optional
# sequence header that overrides the one in the body, and the document text.
RAW_WRITES = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("op", T.StringType()),
        T.StructField("path_type", T.StringType()),
        T.StructField("path_id", T.StringType()),
        T.StructField("header_seq", T.LongType()),
        T.StructField("body", T.StringType()),
    ]
)

# What a reader adds to raw writes: the text of a line that is no such row, and where it was read.
UNREADABLE = "unreadable"
READ_WRITES = T.StructType([*RAW_WRITES, T.StructField(UNREADABLE, T.StringType())])

# One request holding a list of documents under `data`.
RAW_BATCHES = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("body", T.StringType()),
    ]
)
