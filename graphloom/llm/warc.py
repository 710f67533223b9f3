"""Operator 2: WARC archives with segmented records and chunked transfer framing.

``write_archives`` turns rows into WARC/1.1 records: an HTTP response whose body is
the payload in chunked framing, or a revisit record for a payload that an earlier
response already holds. A record block longer than ``segment_bytes`` is cut into a
first segment and continuation records. The files are gzip members of bounded
size, written by Spark's own writer to a folder that all executors share.

``read_archives`` reads the files back. Whole records are decoded where they are
read; segments are grouped by the identifier of their origin record, put in the
order of their segment numbers, checked against the declared total length, and
only then decoded. A record that fails a check raises an error. Archives of others
are read, too: any record type (of one that is no HTTP message the block is the
payload), header names of any case, digests in hex or base 32, gzip members of one
record or many. A file is held whole by the task that reads it.

Defined cases: a null payload counts as empty; payloads under ``least_bytes`` are
never deduplicated; of equal payloads the smallest id is the response (if its row
is repeated, each repetition is), all others revisit it; a null id or URL is left
out of the record and read back as null; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import bounded_batches, new_path, stored

CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORDS_PER_FILE = 2048


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for k in range(0, len(payload), size):
        piece = payload[k : k + size]
        parts += [b"%x\r\n" % len(piece), piece, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; trailers are skipped."""
    parts, pos = [], 0
    while True:
        line = body.index(CRLF, pos)
        size = int(body[pos:line].split(b";")[0], 16)
        if not size:
            if body[line : line + 4] != CRLF + CRLF and body.find(CRLF + CRLF, line + 2) < 0:
                raise ValueError("the body ends before its last chunk does")
            return b"".join(parts)
        parts.append(body[line + 2 : line + 2 + size])
        if len(parts[-1]) != size or body[line + 2 + size : line + 4 + size] != CRLF:
            raise ValueError("broken chunk")
        pos = line + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", len(block))] if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block  # the writer adds the two line ends


def _name(key: int | None, serial: int | None) -> str:
    return f"<urn:graphloom:{'none' if key is None else key}:{serial}>"


def records(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_serial: int | None, serial: int, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The WARC records of one row."""
    name = _name(key, serial)
    head: list[tuple[str, object]] = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Record-ID", name), ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Page-ID", key), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers_to, refers_serial)), ("WARC-Refers-To-Page-ID", refers_to)]
        yield _record(more + head, HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *head], block)
        return
    cuts = range(0, len(block), segment_bytes)
    yield _record([("WARC-Type", "response"), *head, ("WARC-Segment-Number", 1)], block[:segment_bytes])
    for n, k in enumerate(cuts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if n == len(cuts) else []
        fields: list[tuple[str, object]] = [("WARC-Type", "continuation"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Record-ID", f"<urn:graphloom:{serial}:{n}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n), *last]
        yield _record(fields, block[k : k + segment_bytes])


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, segment_bytes: int = 16_384, chunk_bytes: int = 4_096) -> None:
    """Write one response or revisit record per row under ``path``."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("serial", F.monotonically_increasing_id())
    long = rows.filter(F.octet_length("payload") >= least_bytes).select("id", "serial", "digest")
    earliest = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "serial")))
    first = stored(long.groupBy("digest").agg(earliest.alias("f"), F.count("*").alias("n")).filter("n > 1 AND f IS NOT NULL").select("digest", F.col("f.id").alias("first"), F.col("f.serial").alias("first_serial")), "warc-first")
    marked = rows.join(first, "digest", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                columns = [c.to_pylist() for c in batch.slice(k, 64).columns]
                out = [r for row in zip(*columns) for r in records(*row, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = marked.select("id", "url", "payload", "digest", "refers_to", "first_serial", "serial").mapInArrow(run, "value binary")
    text = made.select(F.col("value").cast("string").alias("value"))  # bytes pass through unchanged
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_FIELDS = "id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def parse_fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space goes on with the one before it."""
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header line has no colon")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a decompressed archive file."""
    pos = 0
    while pos < len(data):
        end = data.index(b"\r\n\r\n", pos)
        version, *lines = data[pos:end].decode().split("\r\n")
        if not version.upper().startswith("WARC/"):
            raise ValueError("a record does not start where the one before it ends")
        fields = parse_fields(lines)
        stop = end + 4 + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("the block of a record is not as long as it declares")
        yield fields, data[end + 4 : stop]
        pos = stop + 4


def digest_matches(declared: str | None, payload: bytes) -> bool:
    """Whether the payload has the declared digest (algorithm:value, the value in hex or base 32); one of an unknown algorithm is not judged."""
    kind, _, value = (declared or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    found = hashlib.new(kind, payload)
    return value.strip().lower() in (found.hexdigest(), base64.b32encode(found.digest()).decode().lower(), base64.b32encode(found.digest()).decode().lower().rstrip("="))


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def decode_record(fields: dict[str, str], block: bytes) -> tuple:
    """The row of a whole record; of one that is no HTTP message the whole block is the payload."""
    kind = fields["warc-type"].lower()
    payload, inner = block, {}
    if "application/http" in fields.get("content-type", "").lower() or block.startswith(b"HTTP/"):
        head, _, payload = block.partition(b"\r\n\r\n")
        inner = parse_fields(head.decode("latin-1").split("\r\n")[1:])
        if inner.get("transfer-encoding", "").lower().endswith("chunked") and kind != "revisit":
            payload = dechunked(payload)
    declared = fields.get("warc-payload-digest")
    if kind == "revisit":
        payload, size = None, _number(inner.get("content-length")) or 0
    else:
        size = len(payload)
        if not digest_matches(declared, payload):
            raise ValueError("a payload differs from its digest")
    digest = declared.partition(":")[2].lower() if (declared or "").lower().startswith("sha256:") else None if payload is None else hashlib.sha256(payload).hexdigest()
    return _number(fields.get("warc-page-id")), fields.get("warc-target-uri"), kind, _number(fields.get("warc-refers-to-page-id")), digest, size, payload


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * 7
    if not payloads:
        columns[6] = [None] * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "url", "record_type", "refers_to", "digest", "payload_bytes", "payload"])


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """id, url, record_type, refers_to, digest, payload_bytes and payload (null for revisits, or without ``payloads``) of each archived row."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
        for batch in batches:
            for content in batch.column(0):
                yield from parse_records(_gunzip(content.as_buffer()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for fields, block in parsed(batches):
            if "warc-segment-number" not in fields:
                rows.append(decode_record(fields, block))
                if len(rows) == 128:
                    yield _batch(rows, payloads)
                    rows = []
        yield _batch(rows, payloads)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fields, block in parsed(batches):
            if "warc-segment-number" in fields:
                first = fields["warc-segment-number"] == "1"
                yield pa.RecordBatch.from_pydict({
                    "origin": pa.array([fields["warc-record-id"] if first else fields["warc-segment-origin-id"]]),
                    "number": pa.array([int(fields["warc-segment-number"])], pa.int32()),
                    "total": pa.array([_number(fields.get("warc-segment-total-length"))], pa.int64()),
                    "fields": pa.array([list(fields.items()) if first else None], pa.map_(pa.string(), pa.string())),
                    "block": pa.array([block], pa.binary()),
                })

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(0):
                parts = item.as_py()
                block = b"".join(p["block"] for p in parts)
                numbers = [p["number"] for p in parts]
                if numbers != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                    raise ValueError("segments are missing, or their length differs from the declared total")
                yield _batch([decode_record(dict(parts[0]["fields"]), block)], payloads)

    parts = files.mapInArrow(segments, "origin string, number int, total long, fields map<string,string>, block binary")
    ordered = parts.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "total", "fields", "block")), lambda x, y: x["number"] - y["number"]).alias("parts"))
    return files.mapInArrow(whole, _FIELDS).union(ordered.select("parts").mapInArrow(joined, _FIELDS))


def _gunzip(data: pa.Buffer) -> bytes:
    out, left = [], memoryview(data)
    while len(left):
        member = zlib.decompressobj(31)
        out.append(member.decompress(left))
        left = memoryview(member.unused_data)
    return b"".join(out)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from freshly written archives."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    back = read_archives(pages.sparkSession, path, payloads=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
