"""WARC archives: writing captures with revisits, and assembling them from their records.

A capture is a transaction of three records: the response (or a revisit of one with the same payload), its request, and
metadata that name the page. Request and metadata point at the first by WARC-Concurrent-To; `captures` joins them on it.
Archives are written and read by Spark's own sources, so any file system that Spark knows will do. A file holds FILE_BYTES of
records at most, or one capture, begins with a warcinfo record, and has a gzip member a record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Digits of Java's radix 32 and of base32, in order.
_RADIX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of records, before they are compressed, that close a file.
FILE_BYTES = 64 << 20
#: Bytes that are decompressed at once.
_STEP = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """20 hex digits are 16 in base 32: five of the digest's 40 make four."""
    hex_digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hex_digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _RADIX32, _BASE32)


def _uuid(*parts) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind, record_id, uri, headers: list[tuple[str, Column]], content_type: str, head: Column, body: Column | None, body_bytes: Column | None) -> Column:
    """Headers with a null value are left out."""
    size = F.octet_length(head) + (body_bytes if body is not None else F.lit(0))
    named = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), *headers, ("Content-Type", F.lit(content_type)), ("Content-Length", size.cast("string"))]
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in named]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), head, *([body] if body is not None else []), F.lit("\r\n\r\n"))


def _files(date: str, most: int):
    """Files of gzip members from rows of records."""

    def member(record) -> bytes:
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        return c.compress(record) + c.flush()

    info = b"software: evigraph\r\nformat: WARC File Format 1.1\r\n"

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c) for c in ("request", "main", "metadata"))):
                records = [x.as_buffer() for x in row]
                more = sum(x.size for x in records)
                if size and size + more > most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])
                    held, size = [], 0
                if not held:
                    own = hashlib.md5(records[0]).hexdigest()
                    own = "-".join(own[i:j] for i, j in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{own}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    held.append(member(head.encode() + info + b"\r\n\r\n"))
                held += map(member, records)
                size += more
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])

    return run


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Archives of the pages' captures, as gzip files under path. Spark's text sink names them *.txt and closes each with a
    line end, here a zero byte, which gzip readers pass over as padding.

    Of the pages with one payload of min_bytes or more, the one of the largest id is written as response and the others as
    revisits that refer to it; smaller payloads are all responses. A null html is an empty payload. Rows of the largest id, if
    it is repeated, are all responses, and so are rows without id where none has one. A null url has no WARC-Target-URI; one
    with blanks or control characters is percent-encoded. Repeated rows are written as often as they are there, with the same
    record ids. A page of any size that a row of Spark can hold is one record, in a file of its own if it is that large. An
    empty table gives archives without records. Other columns are not looked at.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    # a row a digest, as a table of its own: both sides of the join are plain exchanges, which Spark can split at a very common page
    first = p.where(F.col("n") >= min_bytes).groupBy(F.col("digest").alias("f_digest")).agg(F.max(F.struct("page_id", "url")).alias("first"))
    first = written(first.select("f_digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "first-pages")
    p = p.join(first, F.col("digest") == F.col("f_digest"), "left")
    page, url, digest = F.col("page_id"), F.col("url"), F.col("digest")
    revisit = (F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~page.eqNullSafe(F.col("first"))
    own = lambda kind, id_=page, of=url: _uuid(F.lit(kind), id_, digest, F.xxhash64(of))
    encoded = lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.url_encode(c)).otherwise(c)
    uri = encoded(url)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))]
    refers = [("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("WARC-Refers-To", F.when(revisit, own("main", F.col("first"), F.col("first_url")))),
              ("WARC-Refers-To-Target-URI", F.when(revisit, encoded(F.col("first_url")))), ("WARC-Refers-To-Date", F.when(revisit, F.lit(date)))]
    main = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), own("main"), uri, [*common, *refers],
        "application/http;msgtype=response", http, F.when(revisit, F.lit("")).otherwise(F.col("html")), F.when(revisit, F.lit(0)).otherwise(F.col("n")),
    )
    get = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    with_main = [("WARC-Date", F.lit(date)), ("WARC-Concurrent-To", own("main"))]
    request = _record(F.lit("request"), own("request"), uri, with_main, "application/http;msgtype=request", get, None, None)
    fields = F.concat(F.lit("page: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\r\n"))
    meta = _record(F.lit("metadata"), own("metadata"), uri, with_main, "application/warc-fields", fields, None, None)
    rows = p.select(request.alias("request"), main.alias("main"), meta.alias("metadata")).mapInArrow(_files(date, file_bytes), "file binary")
    rows.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def _pieces(data: memoryview) -> Iterator[bytes]:
    """A file's bytes, decompressed step by step: plain, as one gzip stream or as members with or without zeros between."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for i in range(0, len(data), _STEP):
            yield bytes(data[i : i + _STEP])
        return
    at = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        d = zlib.decompressobj(31)
        while not d.eof:
            part = data[at : at + _STEP]
            if not len(part):
                raise ValueError("a gzip member is cut short")
            yield d.decompress(part)
            at += len(part)
        at -= len(d.unused_data)


def parse(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a file's bytes, by its Content-Length; line ends between records are
    passed over. One record is held at a time."""
    held, more = b"", _pieces(memoryview(data))

    def until(n: int) -> bool:
        nonlocal held
        if len(held) < n:
            parts, size = [held], len(held)
            while size < n and (x := next(more, None)) is not None:
                parts.append(x)
                size += len(x)
            held = b"".join(parts)
        return len(held) >= n

    while True:
        held = held.lstrip(b"\r\n")
        if not held:
            if not until(1):
                return
            continue
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not until(len(held) + 1):
                raise ValueError("the headers of a WARC record are cut short")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not until(end + 4 + size):
            raise ValueError("a WARC record is cut short")
        yield headers, held[end + 4 : end + 4 + size]
        held = held[end + 4 + size :]


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = headers["warc-type"]
    row = {"warc_type": kind, "record_id": headers["warc-record-id"], "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "block_bytes": len(block)}
    row["payload_digest"] = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        row["head"] = head.decode("utf-8", "replace")
        if kind == "response":
            if (found := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != row["payload_digest"]:
                raise ValueError(f"payload digest of {row['record_id']}: {found}")
            row["payload_bytes"] = len(payload)
            if payloads:
                row["payload"] = payload
        else:
            named = dict(x.lower().split(":", 1) for x in row["head"].split("\r\n")[1:] if ":" in x)
            row["payload_bytes"] = int(named.get("content-length", "0"))
    else:
        row["head"] = block.decode("utf-8", "replace")
    return row


_FIELDS = [("warc_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("block_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("head", pa.string()), ("payload", pa.binary())]
RECORDS = "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, block_bytes long, payload_digest string, payload_bytes long, head string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path, plain or gzip, as RECORDS, without warcinfo. Digests of responses are verified;
    damage of any kind is an error."""
    schema = pa.schema(_FIELDS)

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for headers, block in parse(content.as_buffer()):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    rows.append(_row(headers, block, payloads))
                    size += len(block)
                    if len(rows) >= 1_000 or size >= _STEP:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: record_id, target_uri, response (or revisit), request and metadata.

    Records meet under the id that they are concurrent to, a response or revisit under its own: one pass over the records, one
    exchange. Request and metadata are null where a capture has none. Records that are concurrent to nothing known belong to
    no capture. A response that is there n times gives n captures, each with the same request and metadata.
    """
    kind = F.col("warc_type")
    main = kind.isin("response", "revisit")
    nested = F.struct("record_id", *[c for c in records.columns if c not in ("record_id", "concurrent_to")])
    side = F.struct("record_id", "target_uri", "date", "head")
    x = records.where(main | (kind.isin("request", "metadata") & F.col("concurrent_to").isNotNull()))
    x = x.groupBy(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("of")).agg(
        F.max(F.when(main, nested)).alias("response"), F.max(F.when(kind == "request", side)).alias("request"), F.max(F.when(kind == "metadata", side)).alias("metadata"), F.count_if(main).cast("int").alias("n"),
    )
    x = x.where(F.col("n") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return x.select(F.col("of").alias("record_id"), F.col("response")["target_uri"].alias("target_uri"), "response", "request", "metadata")


def field(head: Column, name: str) -> Column:
    """A field of a metadata record's block; null if it is absent or empty."""
    return F.nullif(F.regexp_extract(head, rf"(?m)^{name}: *(\S*)", 1), F.lit(""))


def resolved(captures: DataFrame, page: Column) -> DataFrame:
    """(record_id, page, payload_bytes, payload_digest, record_type, refers_to) of every capture.

    page: a capture's own name, read from any of its columns, such as a field of its metadata. refers_to of a revisit is the page of
    the response that its WARC-Refers-To names, whoever wrote the archive; null where none of these captures is that response, where
    it has no page, and for responses. A record id that several responses share stands for their largest page. Rows stay as often as
    they are there; no captures give no rows.
    """
    main = F.col("response")
    x = captures.select("record_id", page.alias("page"), main["payload_bytes"].alias("payload_bytes"), main["payload_digest"].alias("payload_digest"), main["warc_type"].alias("record_type"), main["refers_to"].alias("refers"))
    x = written(x, "captures")
    # a table of its own, so that Spark can split the join at a response that very many captures revisit; responses take no part
    named = written(x.where("record_type = 'response'").groupBy(F.col("record_id").alias("of")).agg(F.max("page").alias("refers_to")), "responses")
    revisit = F.col("record_type") == "revisit"
    found = x.where(revisit).join(named, F.col("refers") == F.col("of"), "left").drop("refers", "of")
    return found.unionByName(x.where(~revisit).drop("refers").withColumn("refers_to", F.lit(None).cast(x.schema["page"].dataType)))
