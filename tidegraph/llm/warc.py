"""WARC archives: write captures, read them back, and put transactions together.

A capture is three records: request, response (or revisit) and metadata; request and
metadata name the record they belong with in WARC-Concurrent-To.  Of
captures with equal payloads the one with the smallest page_id is the response and the others revisit it.

Records are written through Spark's text writer as archives of about `ARCHIVE_BYTES` each; a record ends
in the two line ends that the format asks for, which is the writer's line separator.  They are
read as whole files, which the writer keeps small, and parsed by Content-Length.

Assembly follows concurrent-to identifiers, also by way of a request, to the response or revisit they
lead to and folds all records of a capture into one nested row.  Records that lead nowhere
make no row; of several requests or metadata records of a capture the one with the
least record id is taken, and their number is told.

A null payload is empty, a null url is written as `urn:page:` with the id, and rows without an id
are no captures and are left out.  Repeated rows are
captures of their own, all of them responses if the smallest id is repeated.  Record ids follow from page id and payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.lineage import cut, shared_folder
from tidegraph.llm.base import map_batches
from tidegraph.skew import join_unique

ARCHIVE_BYTES = 16 << 20
LEAST_BYTES = 0
END = "\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}')}>"


def record(kind: str, own_id: str, headers: dict[str, str], block: str) -> str:
    """A record as text, without the line ends after it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers.items()]
    return "\r\n".join([*lines, f"Content-Length: {len(block.encode())}", "", block])


def capture_records(page_id: int, url: str | None, html: str, first: int) -> list[str]:
    """The three records of a capture; `first` is the page that holds the payload."""
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    host, _, path = target.partition("://")[2].partition("/")
    size, digest = len(html.encode()), payload_digest(html.encode())
    kind = "response" if page_id == first else "revisit"
    main = record_id(kind, page_id, digest)
    named = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}"}
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    body = html
    if kind == "revisit":
        body = ""
        named["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        named["WARC-Refers-To"] = record_id("response", first, digest)
    named["Content-Type"] = "application/http; msgtype=response"
    joined = {"WARC-Target-URI": target, "WARC-Concurrent-To": main}
    ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n"
    told = f"page: {page_id}\r\npayload-bytes: {size}\r\n" + (f"refers-to-page: {first}\r\n" if kind == "revisit" else "")
    return [
        record("request", record_id("request", page_id, digest), joined | {"Content-Type": "application/http; msgtype=request"}, ask),
        record(kind, main, named, head + body),
        record("metadata", record_id("metadata", page_id, digest), joined | {"Content-Type": "application/warc-fields"}, told),
    ]


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a capture per row of `pages` (page_id, url, html) as WARC files below `folder`.

    Payloads of fewer than `least_bytes` bytes are always responses.
    """
    rows = pages.filter("page_id IS NOT NULL").select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    firsts = cut(
        rows.filter(F.octet_length("html") >= least_bytes)
        .groupBy("sha")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # Digests decide without the payloads; these are dealt by page, so no payload that many pages share heaps up.
    known = join_unique(rows.filter(F.octet_length("html") >= least_bytes).select("page_id", "sha"), firsts, ["sha"])
    revisits = known.filter("first <> page_id").select("page_id", "sha", "first").distinct()
    told = rows.join(revisits, ["page_id", "sha"], "left").select(
        "page_id", "url", "html", F.coalesce("first", "page_id").alias("first")
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled = 0, 0
        for batch in batches:
            lines, parts = [], []
            for row in batch.to_pylist():
                found = capture_records(row["page_id"], row["url"], row["html"], row["first"])
                lines += found
                parts += [part] * len(found)
                filled += sum(map(len, found))
                if filled > ARCHIVE_BYTES:
                    part, filled = part + 1, 0
            yield pa.RecordBatch.from_pydict({"value": lines, "part": pa.array(parts, pa.int32())})

    records = map_batches(told, step, "value string, part int")
    records.write.partitionBy("part").option("lineSep", END).option("compression", "gzip").mode("overwrite").text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """The records of an archive: headers by lower-case name, and the block."""
    at = 0
    while (begin := data.find(b"WARC/", at)) >= 0:
        head = data.find(b"\r\n\r\n", begin)
        if head < 0:
            return
        headers: dict[str, list[str]] = {}
        for line in data[begin:head].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        yield headers, data[head + 4 : head + 4 + size]
        at = head + 4 + size


def _parsed(block: bytes, kind: str) -> tuple[str | None, str | None, str | None, dict[str, str] | None]:
    """(method, target, payload, fields) as far as the kind of record has them."""
    if kind == "metadata":
        pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line)
        return None, None, None, {k.strip(): v.strip() for k, _, v in pairs}
    head, _, body = block.partition(b"\r\n\r\n")
    if kind == "request":
        method, _, rest = head.split(b"\r\n")[0].decode("utf-8", "replace").partition(" ")
        return method, rest.rpartition(" ")[0], None, None
    return None, None, body.decode("utf-8", "replace") if kind == "response" else None, None


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives below `folder`; a response's payload digest is worked out again."""
    import gzip

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                data = content.as_py()
                data = gzip.decompress(data) if path.endswith(".gz") else data
                out = []
                for headers, block in parse(data):
                    one = {k: v[0] for k, v in headers.items()}
                    kind = one.get("warc-type", "")
                    method, target, payload, fields = _parsed(block, kind)
                    body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    out.append(
                        {
                            "record_id": one.get("warc-record-id"),
                            "kind": kind,
                            "concurrent_to": headers.get("warc-concurrent-to", []),
                            "url": one.get("warc-target-uri"),
                            "refers_to_id": one.get("warc-refers-to"),
                            "told_digest": (one.get("warc-payload-digest") or "").rpartition(":")[2] or None,
                            "digest": None if body is None else payload_digest(body),
                            "payload_bytes": None if body is None else len(body),
                            "payload": payload,
                            "method": method,
                            "target": target,
                            "fields": None if fields is None else list(fields.items()),
                        }
                    )
                for k in range(0, len(out), 500):
                    yield pa.RecordBatch.from_pylist(out[k : k + 500], schema=_RECORD)

    return map_batches(files, step, _RECORD_SQL)


_RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("kind", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("url", pa.string()),
        ("refers_to_id", pa.string()),
        ("told_digest", pa.string()),
        ("digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.string()),
        ("method", pa.string()),
        ("target", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
)
_RECORD_SQL = (
    "record_id string, kind string, concurrent_to array<string>, url string, refers_to_id string, told_digest string, "
    "digest string, payload_bytes long, payload string, method string, target string, fields map<string, string>"
)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit, with the request and metadata that lead to it through concurrent-to ids."""
    main = F.col("kind").isin("response", "revisit")
    beside = cut(records.filter(~main).select("record_id", "kind", "concurrent_to", "method", "target", "fields"))
    links = beside.select("record_id", "kind", F.explode("concurrent_to").alias("to"))
    requests = links.filter("kind = 'request'").select(F.col("record_id").alias("_via"), F.col("to").alias("_main"))
    leads = links.join(requests, F.col("to") == F.col("_via"), "left").select(
        F.col("record_id").alias("_from"), F.coalesce("_main", "to").alias("capture")
    )
    sides = beside.join(leads.distinct(), F.col("record_id") == F.col("_from"))
    request = F.when(F.col("kind") == "request", F.struct("record_id", "method", "target"))
    # A map has no order, so metadata is folded by its id and its entries.
    noted = F.when(F.col("kind") == "metadata", F.struct("record_id", F.map_entries("fields").alias("entries")))
    folded = sides.groupBy("capture").agg(
        F.min(request).alias("request"),
        F.map_from_entries(F.min(noted)["entries"]).alias("metadata"),
        F.count_if(F.col("kind") == "request").alias("n_requests"),
        F.count_if(F.col("kind") == "metadata").alias("n_metadata"),
    )
    captures = records.filter(main).drop("method", "target", "fields", "concurrent_to")
    return captures.join(folded, F.col("record_id") == F.col("capture"), "left").drop("capture")


def captures(records: DataFrame) -> DataFrame:
    """The transactions with what their metadata tells: page_id, payload size and digest, and the page a revisit refers to."""
    told = F.col("metadata")
    whole = F.coalesce("payload_bytes", F.try_element_at(told, F.lit("payload-bytes")).cast("long"))
    return transactions(records).select(
        F.try_element_at(told, F.lit("page")).cast("long").alias("page_id"),
        whole.alias("payload_bytes"),
        F.coalesce("digest", "told_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.try_element_at(told, F.lit("refers-to-page")).cast("long").alias("refers_to"),
        "url",
        "record_id",
        "refers_to_id",
        (F.col("digest") == F.col("told_digest")).alias("digest_ok"),
        "payload",
        "request",
        "metadata",
        F.coalesce("n_requests", F.lit(0)).alias("n_requests"),
        F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write `pages` as archives in the shared folder and read their captures back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    write_archives(pages, folder, least_bytes)
    return captures(read_records(spark, folder))
