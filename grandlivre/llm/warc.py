"""Legacy ARC archives: write, parse by version-specific header lines, convert to WARC, and read WARC.

ARC. A file begins with a ``filedesc://`` record whose content states the version and the field names;
version 1 lines have five fields (URL, IP, date, type, length), version 2 lines ten (result code, checksum,
location, offset and file name come before the length). The declared length alone says where a record ends,
so contents may hold any bytes, including lines that look like headers.

Conversion. Each ARC record gives a WARC record with a synthetic identifier (an RFC 4122 version 5 UUID of
its address, date, page and payload digest), the ARC date as an ISO timestamp, and block and payload digests (SHA-1 in
base 32). Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page
id becomes ``response``; the others become ``revisit`` records that carry no payload and name it.

Files are written by Spark's text writer with the format's own record separator, so they go to whatever
store the session uses. A task begins a new archive after ``ARCHIVE_ROWS`` records. A reader holds one archive
and its unpacked bytes in memory; Spark's binary reader takes files of up to 2 GB.

Null html is an empty payload. Null urls become ``urn:page:<id>``; blanks and control characters in urls
are percent-encoded. An empty table gives an archive without records and no rows. Repeated rows (equal
page_id too) are records of their own, of which revisits stay revisits of the one with the largest id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

V1_FIELDS = b"URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: %s\r\n\r\n"
WARC_END = b"\r\n\r\n"
#: Records of an archive, its first one included.
ARCHIVE_ROWS = 2000


def sha1(data: bytes) -> str:
    """Bare upper-case base 32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_id(http: bytes) -> int | None:
    """The page that a record's header names."""
    found = re.search(rb"(?i)\r\nX-Page-Id: (-?\d+)", http)
    return int(found[1]) if found else None


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000") -> None:
    """Write ``pages`` (page_id, url, html) as ARC files of ``version`` 1 or 2, one for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = b"%d 0 spark\n%s\n" % (version, V2_FIELDS if version == 2 else V1_FIELDS)
        head_line = b"filedesc://part.arc 0.0.0.0 %s text/plain " % date.encode() + (b"200 - - 0 part.arc " if version == 2 else b"")
        head_line += b"%d\n" % len(about) + about
        offset = rows = 0
        yield pa.RecordBatch.from_arrays([pa.array([head_line])], names=["value"])
        for batch in batches:
            out = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += 1
                if rows % ARCHIVE_ROWS == 0:  # the writer begins a new file here
                    out.append(head_line)
                    rows, offset = 1, 0
                address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page}"
                content = (HTTP % ("-" if page is None else page)).encode() + (html or "").encode()
                extra = f"200 {hashlib.md5(content).hexdigest()} - {offset} part.arc " if version == 2 else ""
                out.append(f"{address} 0.0.0.0 {date} text/html {extra}{len(content)}\n".encode() + content)
                offset += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", ARCHIVE_ROWS).option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")


def _plain(data: bytes) -> bytes:
    """The bytes of an archive; gzip members are unpacked one after the other."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """(url, 14-digit date, type, content) of each record of an ARC file, by declared lengths.

    The fields' places come from the version block. A damaged header line or a length beyond the end of the
    file ends the archive with an error that names the place; nothing is skipped in silence.
    """
    at, fields = 0, 5
    while at < len(data):
        end = data.find(b"\n", at)
        parts = data[at:end].split(b" ")
        if end < 0 or len(parts) != (fields if at else len(parts)) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        content = data[end + 1 : end + 1 + int(parts[-1])]
        if len(content) != int(parts[-1]):
            raise ValueError(f"the ARC record at byte {at} is cut off")
        if not at:
            fields = len(content.split(b"\n")[1].split(b" "))
        else:
            yield parts[0].decode(), parts[2].decode(), parts[3].decode(), content
        at = end + 1 + len(content) + 1


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, date, http (header), payload_bytes, payload_digest and, if wanted, payload of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for url, date, _, content in arc_records(_plain(data.as_py())):
                    http, _, payload = content.partition(b"\r\n\r\n")
                    page = page_id(http)
                    rows.append((page, url, date, http, len(payload), sha1(payload), payload if payloads else None))
                    held += len(content)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "url", "date", "http", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.binary()]
    return _archives(spark, path).mapInArrow(run, "page_id long, url string, date string, http binary, payload_bytes long, payload_digest string, payload binary")


def record_id(url: str, date: str, page: int | None, digest: str) -> str:
    """The synthetic identifier of a converted record; records of one page and address differ by their payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date} {page} {digest} {url}')}>"


def warc_record(kind: str, url: str, date: str, page: int | None, digest: str, block: bytes, refers_to: str | None = None) -> bytes:
    """A WARC 1.0 record without its closing blank lines."""
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: {url}", f"WARC-Date: {iso}", f"WARC-Record-ID: {record_id(url, date, page, digest)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def convert(arc: DataFrame, least_bytes: int = 0) -> DataFrame:
    """WARC records (value binary) of parsed ARC records, with revisits for repeated payloads.

    Equal payloads meet as digests: a count and the record with the largest page id, combined before the
    shuffle. Payloads travel once, keyed by page.
    """
    small = arc.where(F.col("payload_bytes") >= least_bytes)
    own = F.struct("page_id", "url", "date")
    first = small.groupBy("payload_digest").agg(F.max(own).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # written, so that Spark splits the tasks of a payload that many pages share;
    # of records of the same page, address and payload the one of the first row stays the response
    joined = arc.join(materialize(first, "payloads"), "payload_digest", "left").withColumn("first", F.when(F.col("payload_bytes") >= least_bytes, F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, date, http, digest, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = http + b"\r\n\r\n"
                if first is None or first["page_id"] == page:
                    out.append(warc_record("response", url, date, page, digest, head + payload))
                else:
                    out.append(warc_record("revisit", url, date, page, digest, head, record_id(first["url"], first["date"], first["page_id"], digest)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return joined.select("page_id", "url", "date", "http", "payload_digest", "payload", "first").mapInArrow(run, "value binary")


def write_warc(records: DataFrame, path: str) -> None:
    """Write WARC records as gzip files of one task each."""
    text = records.select(F.col("value").cast("string"))
    text.write.option("lineSep", WARC_END.decode()).option("maxRecordsPerFile", ARCHIVE_ROWS).option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths; digests of blocks are checked."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC header at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
        if "sha1:" + sha1(block) != headers.get("WARC-Block-Digest", "sha1:" + sha1(block)):
            raise ValueError(f"the block of the WARC record at byte {at} differs from its digest")
        yield headers, block
        at = end + 4 + len(block) + len(WARC_END)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, url, date, record_type, page_id, payload_digest, payload_bytes (of responses), refers_to_id.

    The payload of a response is digested again and must match its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in warc_records(_plain(data.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response" and sha1(payload) != digest:
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} differs from its digest")
                    page = page_id(http)
                    rows.append((h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"], kind, page, digest, len(payload) if kind == "response" else None, h.get("WARC-Refers-To")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["record_id", "url", "date", "record_type", "page_id", "payload_digest", "payload_bytes", "refers_to_id"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.string()]
    return _archives(spark, path).mapInArrow(run, "record_id string, url string, date string, record_type string, page_id long, payload_digest string, payload_bytes long, refers_to_id string")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits take what they name.

    The revisits of one payload, however many, find it by a broadcast or a join that Spark may split.
    """
    named = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"))
    named = named.join(records.where("refers_to_id is not null").select("refers_to_id").distinct(), "refers_to_id", "left_semi").dropDuplicates(["refers_to_id"])
    out = records.join(materialize(named, "named"), "refers_to_id", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
