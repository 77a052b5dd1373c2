"""WARC archives: a JVM-side writer and a salvaging reader.

The writer builds each record as one string and lets Spark's text writer put
the records, separated by the blank lines that end a WARC record, into files.
Spark's commit protocol thus covers lost executors, and any store Spark can
write to will do.

The reader checks each record (version line, header block, length, closing
blank lines, digest). Where a check fails it searches for the next version
line or gzip member and goes on there; the bytes passed over are returned as
quarantined gaps, so every byte of an archive is in one record or one gap.

Defined results: a null html is an empty payload; a null page_id sorts after
all others and comes back null; rows that repeat both page_id and payload are
all responses if their page_id is the smallest of the payload; a null url
leaves out the target URI; an empty table gives an empty result. Columns of
the input other than page_id, url and html are left alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .staging import Stage, prepare

#: Payloads of fewer bytes are always stored whole.
MIN_REVISIT_BYTES = 100
#: (payload bytes below this, records in one file at most): a file holds about 64 MiB at most, or one record.
FILE_CLASSES = ((1 << 16, 1024), (1 << 22, 16), (None, 1))
WARC_DATE = "1970-01-01T00:00:00Z"
ID_PREFIX = "urn:quire:page:"

READ_SCHEMA = (
    "file string, kind string, offset long, length long, record_type string, page_id long, "
    "refers_to long, url string, payload_bytes long, payload_digest string, reason string"
)


def annotate(pages: DataFrame, stage: Stage) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, first: the response's page_id where another row has the payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"),
    )
    shared = (
        base.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("payload_digest", "first")
    )
    # Written, so that its size is known: small, it is broadcast; else both sides are shuffled and hot payloads split by AQE.
    return base.join(stage.write(shared, "shared"), "payload_digest", "left")


def record_text(annotated: DataFrame) -> DataFrame:
    """One `value` per row: the WARC record up to, without, its closing blank lines."""
    crlf = "\r\n"
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    rid = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(crlf * 2),
    )
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    header = F.concat_ws(
        crlf,
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), rid(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), uri),  # null, and so left out, with a null url
        F.lit(f"WARC-Date: {WARC_DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(F.concat(http, body).cast("binary"), 256)),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), rid(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")),
    )
    return annotated.select(F.concat(header, F.lit(crlf * 2), http, body).alias("value"))


def write_archives(pages: DataFrame, path: str, stage: Stage) -> list[str]:
    """Write one record per row under `path`; returns the folders, one for each class of payload size."""
    rows, out, low = annotate(pages, stage), [], 0
    for below, most in FILE_CLASSES:
        part = rows.filter(F.col("payload_bytes") >= low) if low else rows
        part = part.filter(F.col("payload_bytes") < below) if below else part
        at = f"{path}/from-{low}"
        record_text(part).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(at)
        out.append(at)
        low = below
    return out


# --------------------------------------------------------------------------- reading

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: A version line (a truncated record may run into it) before a header line, or a gzip member's first bytes.
_CANDIDATE = re.compile(rb"WARC/1\.[01]\r\n(?=[A-Za-z-]+:)|\x1f\x8b\x08")


_SINGLE = frozenset(("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"))


class BadRecord(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record at `at`; BadRecord if a check fails."""
    if not _VERSION.match(data, at):
        raise BadRecord("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise BadRecord("header block does not end")
    headers = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise BadRecord("malformed header line")
        key = name.strip().lower().decode("utf-8", "replace")
        if key in headers and key in _SINGLE:
            raise BadRecord("a header that occurs once is repeated")
        headers[key] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise BadRecord("bad content length")
    start, end = head_end + 4, head_end + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise BadRecord("record is not closed where its length says")
    block = data[start:end]
    if (d := headers.get("warc-block-digest")) and not _digest_ok(d, block):
        raise BadRecord("block digest differs")
    if headers.get("warc-type") == "response" and (d := headers.get("warc-payload-digest")) and not _digest_ok(d, http_payload(block)):
        raise BadRecord("payload digest differs")
    return headers, block, end + 4


def _digest_ok(stated: str, data: bytes) -> bool:
    kind, _, value = stated.partition(":")
    return kind != "sha256" or hashlib.sha256(data).hexdigest() == value.lower()


def http_payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _member(data: bytes, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
    """The records of the gzip member at `at`, and its end."""
    d, parts, end, step = zlib.decompressobj(31), [], at, 1 << 16
    try:
        while not d.eof and end < len(data):
            parts.append(d.decompress(data[end : end + step]))
            end = min(end + step, len(data))
    except zlib.error as e:
        raise BadRecord(f"gzip: {e}") from None
    if not d.eof:
        raise BadRecord("gzip member does not end")
    plain, found, p = b"".join(parts), [], 0
    while p < len(plain):
        headers, block, p = parse_record(plain, p)
        found.append((headers, block))
    return found, end - len(d.unused_data)


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason), in order, covering all bytes.

    A gap runs from the failed record to the next place where a record or
    member passes all checks, or to the end.
    """
    p, gap, reason = 0, None, ""
    while p < len(data):
        try:
            if data.startswith(b"\x1f\x8b", p):
                records, end = _member(data, p)
            else:
                headers, block, end = parse_record(data, p)
                records = [(headers, block)]
        except BadRecord as e:
            if gap is None:
                gap, reason = p, str(e)
            m = _CANDIDATE.search(data, p + 1)
            p = m.start() if m else len(data)
            continue
        if gap is not None:
            yield "gap", gap, p, reason
            gap = None
        for headers, block in records:
            yield "record", p, end, headers, block
        p = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def _page_id(uri: str | None) -> int | None:
    m = re.fullmatch(rf"<{ID_PREFIX}(-?\d+)>", uri or "")
    return int(m[1]) if m else None


_HTTP_LENGTH = re.compile(rb"(?im)^content-length:\s*(\d+)\s*$")


def _row(file: str, item: tuple) -> dict:
    kind, start, end = item[:3]
    row = {"file": file, "kind": kind, "offset": start, "length": end - start}
    if kind == "gap":
        return row | {"reason": item[3]}
    headers, block = item[3:]
    payload = http_payload(block)
    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    if headers.get("warc-type") == "revisit":  # of the full payload
        m = _HTTP_LENGTH.search(block.partition(b"\r\n\r\n")[0].replace(b"\r", b""))
        size, digest = int(m[1]) if m else None, headers.get("warc-payload-digest", "").partition(":")[2] or None
    return row | {
        "record_type": headers.get("warc-type"),
        "page_id": _page_id(headers.get("warc-record-id")),
        "refers_to": _page_id(headers.get("warc-refers-to")),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read_archives(spark: SparkSession, paths: list[str], with_payload: bool = False) -> DataFrame:
    """Records and quarantined gaps of all archives (plain or gzip, one member a record) under the folders.

    Spark reads an archive as one value, so archives must be below 2 GiB; the
    writer above keeps its own at about 64 MiB.
    """
    prepare(spark)
    ddl = READ_SCHEMA + (", payload binary" if with_payload else "")
    schema = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(","))])

    def read(batches):
        for batch in batches:
            names, contents = batch.column("path"), batch.column("content")
            for i in range(len(names)):
                rows, size = [], 0
                for item in salvage(contents[i].as_buffer().to_pybytes()):
                    rows.append(_row(names[i].as_py(), item))
                    size += item[2] - item[1] if with_payload else 1000
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).filter("length > 0")
    return files.select("path", "content").mapInArrow(read, ddl)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive `pages`, read the archives back: one row per record (READ_SCHEMA without gaps, of which there are none)."""
    stage = Stage(spark, "warc")
    folders = write_archives(pages, stage.path("archives"), stage)
    return read_archives(spark, folders).filter("kind = 'record'")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP1_SQL = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             CASE WHEN strlen(coalesce(html, '')) >= 100 THEN min(page_id) OVER (PARTITION BY coalesce(html, '')) END AS first
      FROM pages)
"""
