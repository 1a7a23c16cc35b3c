"""Web archives: legacy ARC records, their conversion to WARC, writing and reading.

ARC has two versions of the line that heads a record: five fields, or ten. The
first block of an archive names its version. The declared length, last in the
line, says where a record ends. WARC needs more than ARC has: identifiers,
timestamps, types and digests are derived from the record itself, so that
converting again gives the same archive.

Records with equal payloads are stored once: that of the largest page id is a
response, the others are revisits that refer to it. Short payloads are always
stored. Pages without an id can be revisits but are referred to by none unless
all copies lack one; then all are responses. Rows repeated with one id are
alike: all responses, or all revisits. A null page is an empty payload, and a
null URL is written as ``-``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm.common import shared_folder, stored

LEAST_SHARED_BYTES = 1000
RECORDS_PER_ARCHIVE = 500
RECORDS_PER_FILE = 2000

# The two headings of ARC records and the line naming them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORDS = (
    "record_id string, record_type string, target_uri string, warc_date string, ip_address string, "
    "page_id bigint, payload_digest string, payload_bytes bigint, block binary, error string"
)
FOUND = (
    "record_id string, record_type string, target_uri string, warc_date string, page_id bigint, payload_bytes bigint, "
    "payload_digest string, refers_to_id string, refers_to bigint, payload binary, error string"
)
_PAGE = re.compile(rb"\r\nX-Page-Id: (-?[0-9]+)\r\n", re.IGNORECASE)
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def arc_record(url: str, date: str, body: bytes, version: int) -> bytes:
    """One ARC record: heading line, body of the declared length, newline."""
    middle = "" if version == 1 else " 200 - - 0 -"
    return f"{url} 0.0.0.0 {date} text/html{middle} {len(body)}\n".encode() + body + b"\n"


def arc_opening(name: str, date: str, version: int) -> bytes:
    body = f"{version} 0 folioscale\n{ARC_FIELDS[version]}\n".encode()
    middle = "" if version == 1 else " 200 - - 0 -"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body + b"\n"


def pages_to_arc(pages: DataFrame, date: str = "20000101000000") -> DataFrame:
    """Pages as ARC archives (name, content), of both versions in turn."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        version = 1
        for batch in batches:
            for begin in range(0, len(batch), RECORDS_PER_ARCHIVE):
                part = batch.iloc[begin : begin + RECORDS_PER_ARCHIVE]
                version = 3 - version
                name = f"pages-v{version}.arc"
                pieces = [arc_opening(name, date, version)]
                for page_id, url, html in zip(part["page_id"], part["url"], part["html"], strict=True):
                    payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                    address = _UNSAFE.sub(lambda sign: f"%{ord(sign.group()):02X}", url) if isinstance(url, str) and url else "-"
                    named = f"X-Page-Id: {page_id}\r\n" if page_id else ""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n"
                    pieces.append(arc_record(address, date, head.encode() + payload, version))
                yield pd.DataFrame({"name": [name], "content": [b"".join(pieces)]})

    # Ids as text: a missing one would turn the column into floating point.
    columns = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return columns.mapInPandas(build, "name string, content binary")


def read_arc(data: bytes) -> Iterator[tuple[list[str], bytes]]:
    """The heading fields and body of each record; ValueError where lengths do not fit."""
    position, version = 0, None
    while position < len(data):
        if data[position : position + 1] in (b"\n", b"\r"):
            position += 1
            continue
        end = data.find(b"\n", position)
        if end < 0:
            raise ValueError(f"heading without end at byte {position}")
        line = data[position:end].decode("utf-8", "replace").rstrip("\r")
        # A URL may hold spaces, the other fields do not.
        fields = line.rsplit(" ", 9 if version == 2 else 4)
        if version is None:
            fields = line.split(" ")
        if not fields[-1].isdigit():
            raise ValueError(f"no length at byte {position}")
        body = data[end + 1 : end + 1 + int(fields[-1])]
        if len(body) < int(fields[-1]):
            raise ValueError(f"record at byte {position} is cut short")
        position = end + 1 + len(body)
        if version is None:
            version = 2 if body[:2] == b"2 " else 1
            continue
        yield fields, body


def warc_date(arc_date: str) -> str:
    digits = (re.sub("[^0-9]", "", arc_date) + "19700101000000"[len(re.sub("[^0-9]", "", arc_date)) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def _payload(block: bytes) -> bytes:
    if not block.startswith(b"HTTP/"):
        return block
    head, gap, payload = block.partition(b"\r\n\r\n")
    return payload if gap else b""


def converted(fields: list[str], body: bytes) -> dict:
    """A WARC record for an ARC record."""
    payload = _payload(body)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    known = hashlib.sha1(f"{fields[0]} {fields[2]} ".encode() + hashlib.sha1(body).digest()).digest()
    head, gap, _ = body.partition(b"\r\n\r\n")
    # The id stands in the HTTP head; what looks like one in the payload is payload.
    page = _PAGE.search(head + b"\r\n") if gap and body.startswith(b"HTTP/") else None
    return {
        "record_id": f"<urn:uuid:{uuid.UUID(bytes=known[:16], version=5)}>",
        "record_type": "response" if body.startswith(b"HTTP/") else "resource",
        "target_uri": fields[0],
        "warc_date": warc_date(fields[2]),
        "ip_address": fields[1],
        "page_id": int(page.group(1)) if page else None,
        "payload_digest": f"sha1:{digest}",
        "payload_bytes": len(payload),
        "block": body,
        "error": None,
    }


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    columns = [part.split()[0] for part in schema.split(", ")]
    return pd.DataFrame({name: pd.Series([row.get(name) for row in rows], dtype=object) for name in columns})


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """WARC records of ARC archives; a broken archive ends in one row with ``error``."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                try:
                    rows += (converted(fields, body) for fields, body in read_arc(content or b""))
                except ValueError as problem:
                    rows.append({"error": str(problem)})
                if rows:
                    yield _frame(rows, RECORDS)

    return archives.select("content").mapInPandas(convert, RECORDS)


def mark_revisits(records: DataFrame, least_bytes: int = LEAST_SHARED_BYTES) -> DataFrame:
    """Add ``refers_to`` and ``refers_to_id``, and make later copies revisits.

    The groups are small rows. Payloads too short to be shared get keys of
    their own, so that they do not meet in one task.
    """
    long = F.col("payload_bytes") >= least_bytes
    groups = (
        records.where(long)
        .groupBy(F.concat_ws(" ", "payload_digest", "payload_bytes").alias("shared_key"))
        .agg(F.max("page_id").alias("kept_page"), F.max_by("record_id", "page_id").alias("kept_id"))
    )
    key = F.when(long, F.concat_ws(" ", "payload_digest", "payload_bytes")).otherwise(
        F.concat(F.lit("own "), F.coalesce("record_id", F.lit("")))
    )
    revisit = F.col("kept_page").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("kept_page"), F.lit(False))
    return (
        records.withColumn("shared_key", key)
        .join(groups, "shared_key", "left")
        .withColumn("refers_to", F.when(revisit, F.col("kept_page")))
        .withColumn("refers_to_id", F.when(revisit, F.col("kept_id")))
        .withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.col("record_type")))
        .drop("shared_key", "kept_page", "kept_id")
    )


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def warc_text(records: DataFrame) -> DataFrame:
    """One column: each record as the text of a WARC file."""
    revisit = F.col("record_type") == "revisit"
    http = F.col("block").cast("string").startswith("HTTP/")
    head_size = F.instr(F.col("block").cast("string"), "\r\n\r\n") + 3
    # What a revisit keeps is the HTTP head; other blocks are kept whole.
    block = F.when(revisit & http, F.substring(F.col("block").cast("string"), F.lit(1), head_size)).otherwise(
        F.when(revisit, F.lit("")).otherwise(F.col("block").cast("string"))
    )
    kind = F.when(http, "application/http;msgtype=response").otherwise("application/octet-stream")
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Date", F.col("warc_date")),
        _header("WARC-Target-URI", F.col("target_uri")),
        _header("WARC-IP-Address", F.col("ip_address")),
        _header("WARC-Payload-Digest", F.col("payload_digest")),
        _header("WARC-Refers-To", F.col("refers_to_id")),
        _header("WARC-Profile", profile),
        _header("X-Page-Id", F.col("page_id")),
        _header("X-Refers-To-Page", F.col("refers_to")),
        _header("X-Payload-Length", F.col("payload_bytes")),
        _header("Content-Type", kind),
        _header("Content-Length", F.octet_length(block)),
    )
    return records.where(F.col("error").isNull()).select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as compressed WARC files of a bounded number of records each."""
    (
        warc_text(records)
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parsed_warc(data: bytes) -> Iterator[dict]:
    """The records of one WARC file."""
    position = 0
    while True:
        while data[position : position + 2] == b"\r\n":
            position += 2
        if position >= len(data):
            return
        end = data.find(b"\r\n\r\n", position)
        if end < 0 or not data.startswith(b"WARC/", position):
            raise ValueError(f"no record at byte {position}")
        lines = data[position:end].decode("utf-8", "replace").split("\r\n")[1:]
        named = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        block = data[end + 4 : end + 4 + int(named["content-length"])]
        position = end + 4 + len(block)
        digest = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
        size, kind = int(named["x-payload-length"]), named["warc-type"]
        payload = None if kind == "revisit" else _payload(block)
        problem = None
        if payload is not None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            problem = "payload and digest differ"
        yield {
            "record_id": named["warc-record-id"],
            "record_type": kind,
            "target_uri": named.get("warc-target-uri"),
            "warc_date": named.get("warc-date"),
            "page_id": int(named["x-page-id"]) if "x-page-id" in named else None,
            "payload_bytes": size,
            "payload_digest": digest,
            "refers_to_id": named.get("warc-refers-to"),
            "refers_to": int(named["x-refers-to-page"]) if "x-refers-to-page" in named else None,
            "payload": payload,
            "error": problem,
        }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives of a folder; a broken archive ends in one row with ``error``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                try:
                    for row in parsed_warc(_unpacked(content)):
                        rows.append(row if with_payload else row | {"payload": None})
                except (ValueError, KeyError) as problem:
                    rows.append({"error": repr(problem)})
                if rows:
                    yield _frame(rows, FOUND)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, FOUND)


def _unpacked(content: bytes) -> bytes:
    """Of one or more gzip members, or of a plain file."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages through ARC into WARC files in the shared folder, and the records read back."""
    spark = pages.sparkSession
    # Whole pages: what is written once and read twice is packed more tightly.
    records = stored(arc_to_warc(pages_to_arc(pages)), "warc-records", "zstd")
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(mark_revisits(records), path)
    # What could not be converted has no place in an archive, but in the result.
    broken = records.where(F.col("error").isNotNull()).select("error")
    return read_warc(spark, path, with_payload=False).unionByName(broken, allowMissingColumns=True)


def archive_digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
