"""Web archives: records written with segments and chunked bodies, and read back by reassembly.

Blocks longer than ``SEGMENT`` bytes are split into a response record and continuation records. On reading,
segments are grouped by the identifier of their first record, ordered by segment number and checked against the
total length; then the transfer framing of the body is decoded.

Files hold records one after the other, compressed as a whole, with at most ``FILE_RECORDS`` records each, so that
a task can hold a file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, settle, ship

SEGMENT = 65_536
CHUNK = 8_192
FILE_RECORDS = 2_000
LEAST_REVISIT = 100
DATE = "2000-01-01T00:00:00Z"
_CRLF = b"\r\n"
_ID = re.compile(r"<urn:page:(-?\d+|null):(\d+)>")


# -- writing ------------------------------------------------------------------------------------------------


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[k : k + size] for k in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def response_records(ident: str, url: str | None, payload: bytes, digest: str, segment: int = SEGMENT) -> Iterator[bytes]:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", ident), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")], block)
        return
    last = (len(block) - 1) // segment
    for k in range(last + 1):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{ident[:-1]}:{k + 1}>"), *common, ("WARC-Segment-Origin-ID", ident)] if k else [("WARC-Type", "response"), ("WARC-Record-ID", ident), *common, ("WARC-Payload-Digest", f"sha256:{digest}")]
        yield record([*own, ("WARC-Segment-Number", str(k + 1)), ("WARC-Segment-Total-Length", str(len(block)) if k == last else None)], block[k * segment : (k + 1) * segment])


def revisit_record(ident: str, url: str | None, length: int, digest: str, refers_to: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    return record(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", ident), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Refers-To", refers_to), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")],
        block,
    )


def _ident(page: int | None, nth: int) -> str:
    return f"<urn:page:{'null' if page is None else page}:{nth}>"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT) -> None:
    """A response or revisit record per row; the payload is the html in UTF-8.

    Of equal payloads of ``LEAST_REVISIT`` bytes or more, the row with the least id is the response, and rows that repeat
    its id are responses too (null ids come last: without another id, all are responses). Null html is an empty payload;
    null urls have no target field; other columns are not looked at. Rows are numbered in a table that is written once,
    so that a revisit refers to the number under which its response is written.
    """
    spark = pages.sparkSession
    ship(spark)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("nth"))
    src = settle(src.withColumn("digest", F.sha2("html", 256)), "numbered-pages")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "nth")
    firsts = src.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min(order).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = settle(firsts.select("digest", F.col("f.page_id").alias("first_page"), F.col("f.nth").alias("first_nth")), "first-payloads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            size = 0
            for page, url, html, nth, digest, first_page, first_nth in zip(*(c.cast(pa.binary()).to_pylist() if k == 2 else c.to_pylist() for k, c in enumerate(b.columns))):
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url is not None else None
                ident = _ident(page, nth)
                if first_nth is None or first_page == page:
                    made = list(response_records(ident, url, html, digest, segment))
                else:
                    made = [revisit_record(ident, url, len(html), digest, _ident(first_page, first_nth))]
                out += made
                size += sum(map(len, made))
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    cols = ["page_id", "url", "html", "nth", "digest", "first_page", "first_nth"]
    records = src.join(firsts, "digest", "left").select(*cols).mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    discard(spark, src)
    discard(spark, firsts)


# -- reading ------------------------------------------------------------------------------------------------


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields (names in lower case) and block of each record of a file.

    A record that is cut off, or that does not end where its length says, has no block; reading goes on at the next
    record's beginning. What belongs to no record is passed over.
    """
    at, end = 0, len(data)
    while at < end:
        if not data.startswith(b"WARC/", at):
            at = _next_record(data, at)
            continue
        head = data.find(b"\r\n\r\n", at)
        fields = {}
        for line in data[at : head if head >= 0 else end].split(_CRLF)[1:]:
            k, _, v = line.partition(b":")
            fields[k.decode(errors="replace").strip().lower()] = v.decode(errors="replace").strip()
        size = _number(fields.get("content-length"))
        start = head + 4
        if head >= 0 and size is not None and data[start + size : start + size + 4] == b"\r\n\r\n":
            yield fields, data[start : start + size]
            at = start + size + 4
        else:
            yield fields, None
            at = _next_record(data, at + 1)


def _next_record(data: bytes, at: int) -> int:
    found = data.find(b"\r\n\r\nWARC/", max(0, at - 4))
    return len(data) if found < 0 else found + 4


def _number(said: str | None) -> int | None:
    return int(said) if said and re.fullmatch("[0-9]{1,18}", said) else None


def opened(content: bytes) -> bytes:
    """What a compressed file holds, or the part before the place where it breaks; a plain file as it is."""
    if not content.startswith(b"\x1f\x8b"):
        return content
    out = []
    while content:
        d = zlib.decompressobj(zlib.MAX_WBITS | 16)
        for k in range(0, len(content), 1 << 20):
            try:
                out.append(d.decompress(content[k : k + (1 << 20)]))
            except zlib.error:
                return b"".join(out)
            if d.eof:
                content = d.unused_data + content[k + (1 << 20) :]
                break
        else:
            break
    return b"".join(out)


def unchunked(body: bytes) -> bytes | None:
    """The body without transfer framing; chunk extensions and trailers are passed over. None if it breaks off."""
    out, at = [], 0
    while True:
        line = body.find(_CRLF, at)
        if line < 0:
            return None
        try:
            n = int(body[at:line].partition(b";")[0].strip(), 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        chunk = body[line + 2 : line + 2 + n]
        if len(chunk) < n or body[line + 2 + n : line + 4 + n] != _CRLF:
            return None
        out.append(chunk)
        at = line + 4 + n


def http_payload(block: bytes) -> tuple[bytes | None, int | None]:
    """Decoded body of an HTTP message, and the length that its header says."""
    head, found, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(_CRLF)[1:])}
    said = int(fields[b"content-length"]) if fields.get(b"content-length", b"").isdigit() else None
    if not found:
        return None, said
    return (unchunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body), said


_RECORD = {"record_id": "string", "record_type": "string", "url": "string", "refers_to": "string", "digest": "string", "complete": "boolean", "said_bytes": "long", "payload": "binary"}
#: Of segments, ``payload`` is the raw block.
_PART = _RECORD | {"segment": "int", "origin": "string", "total": "long"}
_KINDS = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def _batch(rows: list[tuple], fields: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[v]) for c, v in zip(list(zip(*rows)) or [()] * len(fields), fields.values())], list(fields))


def decoded(kind: str | None, block: bytes | None) -> tuple[bool, int | None, bytes | None]:
    """Whether a record is complete, the length that it says, and its payload. Revisits have no payload."""
    if block is None:
        return False, None, None
    payload, said = http_payload(block)
    return (True, said, None) if kind == "revisit" else (payload is not None, said, payload)


def read_parts(spark, path: str) -> DataFrame:
    """One row per record of the archives: whole ones decoded, segments (``segment`` is not null) as they are. Every file
    is read once."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for f, block in parse_records(opened(content.as_py())):
                    digest, kind, segment = f.get("warc-payload-digest"), f.get("warc-type"), _number(f.get("warc-segment-number"))
                    done = (False, None, block) if segment is not None else decoded(kind, block)
                    rows.append((f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-refers-to"), digest.partition(":")[2] if digest else None, *done, segment, f.get("warc-segment-origin-id"), _number(f.get("warc-segment-total-length"))))
                    size += len(block or b"")
                    if size > 8_000_000:
                        yield _batch(rows, _PART)
                        rows, size = [], 0
                yield _batch(rows, _PART)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, _ddl(_PART))


def reassembled(segments: DataFrame) -> DataFrame:
    """Segments (rows of :func:`read_parts`) of one record each to records; incomplete where they do not add up."""
    key = F.coalesce("origin", "record_id")
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    g = segments.groupBy(key.alias("record_id")).agg(
        *(first(c) for c in ("record_type", "url", "refers_to", "digest")),
        F.sort_array(F.collect_list(F.struct("segment", "payload"))).alias("s"), F.max("total").alias("total"), F.sum(F.octet_length("payload")).alias("sum"), F.max("segment").alias("top"),
        F.count_distinct("segment").alias("distinct"), F.count("*").alias("n"), F.count("payload").alias("whole"),
    )
    good = (F.col("total") == F.col("sum")) & (F.col("top") == F.col("n")) & (F.col("distinct") == F.col("n")) & (F.col("whole") == F.col("n"))
    text = F.array_join(F.transform("s", lambda x: x["payload"].cast("string")), "")  # joins the bytes as they are
    blocks = g.select("record_id", "record_type", "url", "refers_to", "digest", F.when(good, text.cast("binary")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(*r[:5], *decoded(r[1], r[5])) for r in zip(*(c.to_pylist() for c in b.columns))], _RECORD)

    return blocks.mapInArrow(run, _ddl(_RECORD))


def read_archives(spark, path: str) -> DataFrame:
    """``(record_id, record_type, url, refers_to, digest, complete, said_bytes, payload)``, one row per response or
    revisit record. A record is incomplete, and has no payload, where it is cut off or its length is wrong, segments are
    missing or doubled, their lengths do not add up to the total, or the framing breaks off. What was read is written
    once; only segments are shuffled. Repeated records are read each; a folder without archives gives an empty table."""
    parts = settle(read_parts(spark, path), "archive-parts")
    whole = parts.where("segment is null").select(*_RECORD)
    return whole.unionByName(reassembled(parts.where("segment is not null")))


def op2(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+|null):', 1) as bigint)")
    revisit = F.col("record_type") == "revisit"
    return read_archives(spark, path).select(
        page("record_id").alias("page_id"), F.when(revisit, F.col("said_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"), "record_type", F.when(revisit, page("refers_to")).alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest, min(page_id) OVER (PARTITION BY digest) AS least FROM p)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
FROM q
"""
