"""Web archives (WARC 1.1) without repeated payloads, by revisit resolution.

Headers, not payloads, are shuffled by payload digest. Of equal payloads one stays a
response record, the others become revisit records that refer to it; all are written with
fresh headers. Archives are written and read by Spark's text source, with the end of a
record as the end of a line, so any store and any executor will do and uncompressed
archives can be split. All of this is native but for the rare archive whose payloads hold
the start of a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches, table, written

#: Originals up to this number are broadcast: some 200 bytes each.
BROADCAST_ROWS = 100_000
END = "\r\n\r\n"
#: Pieces of an archive are what lies between these; a record's first line lacks it but for the first record.
START = END + "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
    "block_digest": "WARC-Block-Digest", "refers_to_id": "WARC-Refers-To", "content_type": "Content-Type", "content_length": "Content-Length", "page_id": "X-Page-ID",
}


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: forty bits, ten hexadecimal digits, are eight of its digits."""
    hexa = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexa, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uri(*parts: Column) -> Column:
    """A urn:uuid made from the parts, the same whenever it is made."""
    name = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    cuts = [F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("3"), F.substring(name, 14, 3)), F.concat(F.lit("8"), F.substring(name, 18, 3)), F.substring(name, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _in_line(uri: Column) -> Column:
    return F.replace(F.replace(uri, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def originals(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_digest, _sha256, _bytes, _keep_id, _keep_url) of payloads of min_bytes and more that several pages have: the page that stays."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    heads = pages.select(base32_sha1(html.cast("binary")).alias("_digest"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("_sha256"), F.octet_length(html).cast("long").alias("_bytes"), F.struct(F.col(id_col), F.col(url_col)).alias("page"))
    met = heads.where(F.col("_bytes") >= min_bytes).groupBy("_digest", "_sha256", "_bytes").agg(F.max("page").alias("page"), F.count("*").alias("n")).where("n > 1")
    return met.select("_digest", "_sha256", "_bytes", F.col("page")[id_col].alias("_keep_id"), F.col("page")[url_col].alias("_keep_url"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None, compression: str = "gzip", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record for each row of pages, in archives under path.

    The payload is the page's text in UTF-8, empty if null, behind a plain HTTP header. Of
    equal payloads of min_bytes bytes and more, the rows with the largest id are responses
    and the others revisits of it; several rows that share that id are all responses. A null
    id is smaller than any other. Payloads are equal if SHA-1, SHA-256 and length are.
    Line ends in a URL are percent-encoded, a null URL is left out. date, an ISO time, is
    that of every record; now if None. With compression gzip an archive is one gzip stream.
    An empty table gives no record. Columns of other names are ignored.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    kept = written(originals(base, min_bytes, "_id", "_url", "_html"), "warc-originals")
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    data = F.col("_html").cast("binary")
    full = base.withColumns({"_digest": base32_sha1(data), "_sha256": F.unhex(F.sha2(data, 256)), "_bytes": F.octet_length("_html").cast("long")})
    rows = full.join(kept, ["_digest", "_sha256", "_bytes"], "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    time = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("_keep_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keep_id"))
    rows = rows.select("*", revisit.alias("_again"), http.alias("_http")).select("*", F.when(F.col("_again"), F.col("_http")).otherwise(F.concat("_http", "_html")).alias("_block"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))

    only_again = lambda value: F.when(F.col("_again"), value)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("_again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_uri(F.col("_id"), F.col("_url"), F.col("_digest"))),
        line("WARC-Date", time),
        line("WARC-Target-URI", _in_line(F.col("_url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("_block").cast("binary")))),
        line("WARC-Profile", only_again(F.lit(PROFILE))),
        line("WARC-Refers-To", only_again(record_uri(F.col("_keep_id"), F.col("_keep_url"), F.col("_digest")))),
        line("WARC-Refers-To-Target-URI", only_again(_in_line(F.col("_keep_url")))),
        line("WARC-Refers-To-Date", only_again(time)),
        line("X-Page-ID", F.col("_id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
        F.col("_block"),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their archive, put together until each has its whole block."""
    import re

    length = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)", re.I)
    file, held = None, b""

    def whole(piece: bytes) -> bool:
        head, _, block = piece.partition(END.encode())
        found = length.search(head)
        return not found or len(block) >= int(found[1])

    def out(piece: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([piece], pa.binary())], names=["file", "piece"])

    for b in batches:
        for f, piece in zip(b.column("file").to_pylist(), b.column("piece").to_pylist()):
            if f != file:
                if file is not None:
                    yield out(held)
                file, held = f, piece
            elif whole(held):
                yield out(held)
                held = piece
            else:
                held += START.encode() + piece
    if file is not None:
        yield out(held)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, the fields of FIELDS, http_length, payload binary, damaged) of every record of the archives under path.

    Plain archives are split, compressed ones read by a task each. Field names may have any
    case. The payload of a response or resource is its content, that of a revisit null;
    http_length is the Content-Length that the stored HTTP header tells. damaged is true if
    a record has no length, less than its length, or a payload that is not its digest's.
    A payload that holds the start of a record is put together again from the pieces of
    its archive. A folder without records gives no rows.
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", START).text(path)
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))
    head = F.substring_index("piece", END, 1)
    block_bytes = F.octet_length("piece") - F.octet_length(head) - len(END)
    told = F.coalesce(_header(head, "Content-Length").try_cast("long"), F.lit(0))
    cut = written(pieces.where(block_bytes < told).select("file").distinct(), "warc-cut")
    if not cut.isEmpty():
        in_order = pieces.join(cut, "file", "left_semi").select("file", "start", "seq", F.col("piece").cast("binary").alias("piece")).repartition("file").sortWithinPartitions("file", "start", "seq")
        again = in_order.select("file", "piece").mapInArrow(_joined, "file string, piece binary").select("file", F.col("piece").cast("string").alias("piece"))
        pieces = pieces.join(cut, "file", "left_anti").select("file", "piece").union(again)
    parsed = pieces.select("file", "piece", head.alias("head")).where("trim(BOTH '\r\n' FROM head) <> ''")
    parsed = parsed.select("file", "piece", F.octet_length("head").alias("at"), *[_header(F.col("head"), name).alias(f) for f, name in FIELDS.items()])
    length = F.col("content_length").try_cast("long")
    block = F.expr(f"substring(cast(piece AS binary), at + {len(END) + 1}, CAST(coalesce(try_cast(content_length AS long), 0) AS int))")
    parsed = parsed.select("*", block.alias("block"), (length.isNull() | (F.octet_length("piece") - F.col("at") - len(END) < length)).alias("short"))
    http_head = F.substring_index(F.col("block").cast("string"), END, 1)
    is_http = F.coalesce(F.lower("content_type").startswith("application/http"), F.lit(False))
    payload = F.when(F.col("record_type") == "revisit", None).when(is_http, F.expr(f"substring(block, octet_length(substring_index(cast(block AS string), '\\r\\n\\r\\n', 1)) + {len(END) + 1})")).otherwise(F.col("block"))
    parsed = parsed.select("*", F.when(is_http, _header(http_head, "Content-Length").try_cast("long")).alias("http_length"), payload.alias("payload"))
    digest = F.col("payload_digest")
    wrong = F.coalesce(digest.startswith("sha1:") & F.col("payload").isNotNull() & (digest != F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))), F.lit(False))
    return parsed.select("file", *[(length if f == "content_length" else F.col(f)).alias(f) for f in FIELDS], "http_length", "payload", (F.col("short") | wrong).alias("damaged"))


def resolved(records: DataFrame) -> DataFrame:
    """Headers of records, each revisit with the original that it refers to.

    (page_id string, record_type, payload_bytes long, payload_digest bare, refers_to, damaged):
    refers_to is the page of the original; null, with damaged true, if that is in none
    of the archives.
    """
    heads = written(
        records.select("record_id", "page_id", "record_type", F.coalesce(F.octet_length("payload").cast("long"), F.col("http_length")).alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "refers_to_id", "damaged"),
        "warc-headers",
    )
    wanted = heads.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct()
    found = heads.where("record_type = 'response'").join(wanted, "record_id").groupBy(F.col("record_id").alias("_original")).agg(F.max(F.struct("page_id")).alias("_found"))
    found = written(found, "warc-found")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    lost = (F.col("record_type") == "revisit") & F.col("_found").isNull()
    joined = heads.join(found, heads["refers_to_id"] == found["_original"], "left")
    return joined.select("page_id", "record_type", "payload_bytes", "payload_digest", F.col("_found")["page_id"].alias("refers_to"), (F.col("damaged") | lost).alias("damaged"))


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written to archives of this call's own and read back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    out = resolved(read_records(spark, path))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM k
"""
