import base64
import gzip
import hashlib

import duckdb

from emberlog.llm import warc

SCHEMA = "page_id long, url string, html string"
NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
INNER = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 77\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nend"
PAGES = [
    (1, "http://a/1", "<p>ö</p>"), (2, None, "<p>ö</p>"), (3, "http://a/\r\nX: y", "<p>ö</p>"), (4, "http://b", None), (5, "http://b", ""),
    (6, "http://c", INNER), (7, "http://c", INNER), (8, "http://d", "x\r\n\r\n"), (9, "http://e", "long " * 200_000), (10, "http://f", "single"), (11, "u", "WARC/1.1\r\n"),
]


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(pages, least=0):
    top = {}
    for i, _, html in pages:
        top[html or ""] = max(top.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        again = len(data) >= least and top[html or ""] != i
        out.append((i, len(data), digest(data), "revisit" if again else "response", top[html or ""] if again else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(NAMES).collect())


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    pages = PAGES + [(100 + i, "http://copies", "copy") for i in range(30)]
    spark.createDataFrame(pages, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    out = got(warc.op13_warc(spark, str(tmp_path)))
    assert out == brute(pages)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(c.sql(f"SELECT {', '.join(NAMES)} FROM ({warc.OP13_SQL})").fetchall()) == out


def test_plain_archives_are_split_and_payloads_come_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA).coalesce(1), f"{tmp_path}/w", date="2026-01-02T03:04:05Z", compression="none", min_bytes=5)
    for split in ("700b", "64k", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows = warc.read_records(spark, f"{tmp_path}/w").collect()
        assert len(rows) == len(PAGES) and not any(r["damaged"] for r in rows)
        html = {i: h or "" for i, _, h in PAGES}
        assert all(r["payload"] == (html[int(r["page_id"])].encode() if r["record_type"] == "response" else None) for r in rows)
        out = warc.resolved(warc.read_records(spark, f"{tmp_path}/w")).selectExpr("cast(page_id as long) page_id", *NAMES[1:4], "cast(refers_to as long) refers_to")
        assert got(out) == brute(PAGES, 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_headers_are_fresh(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(PAGES[:3], SCHEMA), f"{tmp_path}/w", date="2026-01-02T03:04:05Z")
    rows = {r["page_id"]: r for r in warc.read_records(spark, f"{tmp_path}/w").collect()}
    assert len({r["record_id"] for r in rows.values()}) == 3 and {r["date"] for r in rows.values()} == {"2026-01-02T03:04:05Z"}
    assert rows["1"]["refers_to_id"] == rows["3"]["record_id"] and rows["2"]["target_uri"] is None and rows["3"]["target_uri"] == "http://a/%0D%0AX: y"
    assert rows["1"]["content_length"] < rows["3"]["content_length"] and rows["1"]["http_length"] == 9


def test_archives_of_others(spark, tmp_path):
    def record(head, block):
        return (head + f"content-length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    parts = [
        record("WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\n", b"software: x\r\n"),
        record("WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:" + digest(b"\xff\x00z") + "\r\n", b"\xff\x00z"),
        record("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:WRONG\r\n", b"HTTP/1.1 200 OK\r\n\r\nbody"),
        record("WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Refers-To: <urn:uuid:9>\r\n", b""),
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:4>\r\nContent-Length: 50\r\n\r\ncut",
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    rows = {r["record_id"]: r for r in warc.read_records(spark, f"{tmp_path}/w").collect()}
    assert {k[-2]: r["damaged"] for k, r in rows.items()} == {"0": False, "1": False, "2": True, "3": False, "4": True}
    assert bytes(rows["<urn:uuid:1>"]["payload"]) == b"\xff\x00z" and bytes(rows["<urn:uuid:2>"]["payload"]) == b"body"
    lost = warc.resolved(warc.read_records(spark, f"{tmp_path}/w")).where("record_type = 'revisit'").collect()
    assert [(r["refers_to"], r["damaged"]) for r in lost] == [(None, True)]


def test_repeated_rows_null_ids_clashing_columns_and_empty_tables(spark, tmp_path):
    rows = [(5, "u", "same"), (5, "u", "same"), (4, "u", "same"), (None, "u", "same"), (None, None, "other"), (None, "v", "other")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _html", "2 AS _digest", "3 AS value")
    warc.write_archives(df, f"{tmp_path}/w")
    out = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.resolved(warc.read_records(spark, f"{tmp_path}/w")).collect()]
    assert sorted(out, key=str) == sorted([("5", "response", None)] * 2 + [("4", "revisit", "5"), (None, "revisit", "5")] + [(None, "response", None)] * 2, key=str)
    warc.write_archives(df.where("page_id > 9"), f"{tmp_path}/e")
    assert warc.read_records(spark, f"{tmp_path}/e").count() == 0
