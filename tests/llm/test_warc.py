import base64
import hashlib

from pyspark.sql import functions as F

from tidegraph.llm.warc import captures, parse, read_records, record, round_trip, transactions, write_archives

SF = "/root/testdata/sf0.01"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        if page is not None:
            own = first[html or ""]
            kind = ("response", None) if own == page else ("revisit", own)
            out.append((page, len((html or "").encode()), digest(html or ""), *kind))
    return sorted(out, key=str)


def told(df):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_the_table_comes_back(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.unionByName(pages.limit(40).withColumn("page_id", F.col("page_id") + 100_000))
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert told(round_trip(pages)) == expected(rows)


def test_odd_pages(spark):
    trap = "a\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"
    rows = [(5, "http://a/x", trap), (3, None, trap), (7, "h\nt p", trap), (9, "u", None), (2, "u", ""), (11, "é", "日本"), (11, "é", "日本"), (12, "", "z" * 300_000), (None, "x", "y"), (4, "q", "one"), (4, "q", "two")]
    pages = spark.createDataFrame([(*r, "kept out") for r in rows], "page_id long, url string, html string, payload string")
    got = round_trip(pages).cache()
    assert told(got) == expected(rows)
    payloads = {r.page_id: r.payload for r in got.filter("record_type = 'response'").collect()}
    assert payloads[3] == trap and payloads[2] == "" and payloads[12] == "z" * 300_000
    assert {r.digest_ok for r in got.filter("record_type = 'response'").collect()} == {True}
    assert got.filter("page_id = 7").first().request.method == "GET"
    assert all(r.n_requests >= 1 and r.n_metadata >= 1 for r in got.collect())
    assert round_trip(pages.limit(0)).count() == 0


def test_small_payloads_may_all_be_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert [r[3] for r in told(round_trip(pages, least_bytes=3))] == ["response", "response", "response", "revisit"]


def test_transactions_follow_chains_and_leave_strays(spark, tmp_path):
    parts = [
        record("response", "<r>", {}, "HTTP/1.1 200 OK\r\n\r\nbody"),
        record("request", "<q>", {"WARC-Concurrent-To": "<r>"}, "GET /x HTTP/1.1\r\n\r\n"),
        record("metadata", "<m>", {"WARC-Concurrent-To": "<q>"}, "page: 1\r\n"),
        record("metadata", "<n>", {"WARC-Concurrent-To": "<r>"}, "page: 2\r\n"),
        record("metadata", "<stray>", {"WARC-Concurrent-To": "<nowhere>"}, "page: 3\r\n"),
        record("response", "<alone>", {}, "HTTP/1.1 200 OK\r\n\r\n"),
        record("warcinfo", "<i>", {}, "software: x\r\n"),
    ]
    (tmp_path / "a.warc").write_bytes("\r\n\r\n".join([*parts, ""]).encode())
    rows = {r.record_id: r for r in transactions(read_records(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<r>", "<alone>"}
    assert rows["<r>"].request.record_id == "<q>" and rows["<r>"].n_metadata == 2 and rows["<r>"].metadata == {"page": "1"}
    assert rows["<alone>"].request is None
    found = {r.record_id: r.page_id for r in captures(read_records(spark, str(tmp_path))).collect()}
    assert found == {"<r>": 1, "<alone>": None}


def test_archives_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/p", "x"), (2, "http://h/q", "x")], "page_id long, url string, html string")
    write_archives(pages, str(tmp_path / "w"))
    import gzip

    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").rglob("*.gz")))
    kinds = sorted(h["warc-type"][0] for h, _ in parse(data))
    assert kinds == ["metadata", "metadata", "request", "request", "response", "revisit"]
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
