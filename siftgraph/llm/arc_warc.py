"""Legacy web archives to WARC: write ARC volumes, convert them, read WARC volumes back.

A volume is one task's work from end to end, holds at least one record and about ``VOLUME_BYTES``,
and its records are gzip members of their own. Payloads never go through a shuffle: only digests
do, and a volume is converted where its decisions arrive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, scratch_path
from .common import spread
from .stores import get, put

VOLUME_BYTES = 16 << 20
LEVEL = 1
# Header fields of the two ARC versions.
ARC_V1 = "URL IP-address Archive-date Content-type Archive-length"
ARC_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"


@dataclass
class Arc:
    """One ARC record: its header fields by name, and its block."""

    fields: dict[str, str]
    block: bytes

    @property
    def url(self) -> str:
        return self.fields["URL"]


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def safe_url(url: str | None) -> str:
    """A URL without the blanks and control characters that would break a header line."""
    if not url:
        return "unknown:"
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def arc_opening(name: str, version: int, date: str) -> bytes:
    """The record that opens a volume and says which fields its header lines have."""
    fields = ARC_V1 if version == 1 else ARC_V2
    body = f"{version} 0 siftgraph\n{fields}\n".encode()
    extra = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body + b"\n"


def arc_record(name: str, version: int, date: str, url: str, block: bytes, offset: int) -> bytes:
    extra = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} "
    return f"{url} 0.0.0.0 {date} text/html {extra}{len(block)}\n".encode() + block + b"\n"


def read_arc(raw: BinaryIO) -> Iterator[Arc]:
    """The records of a volume, opening record first, gzip or plain.

    The opening record's block names the version and with it the fields of a header line. Lines
    are split from the right, since version 1 writers let blanks into URLs; the declared length
    says where a record ends. A volume cut short raises EOFError.
    """
    magic = raw.read(2)
    raw.seek(0)
    src = gzip.GzipFile(fileobj=raw) if magic == b"\x1f\x8b" else raw
    names = ARC_V1.split()
    first = True
    while True:
        line = src.readline()
        while line in (b"\n", b"\r\n"):
            line = src.readline()
        if not line:
            return
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if first and len(text.split(" ")) > 5:
            names = ARC_V2.split()
        parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"not an ARC header line: {text[:200]!r}")
        fields = dict(zip(names, parts, strict=True))
        length = int(fields["Archive-length"])
        block = src.read(length)
        if len(block) != length:
            raise EOFError(f"{fields['URL']}: {len(block)} of {length} bytes")
        if first:
            said = block.split(b"\n", 2)
            names = (ARC_V2 if said[0].startswith(b"2") else ARC_V1).split()
            first = False
        yield Arc(fields, block)


def warc_date(date: str) -> str:
    """ARC's 14 digits, or the 12 or 8 of early writers, as WARC has them."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_id(volume: str, index: int) -> str:
    """The same record gets the same identifier whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{volume}:{index}')}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; a block without a head is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, gap, payload = block.partition(b"\r\n\r\n")
    return head + gap, payload


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode() if found else None


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def convert(arc: Arc, volume: str, index: int, original: tuple[str, str, str] | None) -> bytes:
    """A WARC record for an ARC record; ``original`` (id, URL, date) makes it a revisit."""
    date = warc_date(arc.fields["Archive-date"])
    fields = {"WARC-Type": "response", "WARC-Record-ID": warc_id(volume, index), "WARC-Date": date}
    if arc.url.startswith("filedesc:"):
        fields |= {"WARC-Type": "warcinfo", "WARC-Filename": volume, "Content-Type": "application/warc-fields"}
        body = f"software: siftgraph\r\nformat: WARC File Format 1.1\r\nisPartOf: {arc.url}\r\n"
        return warc_record(fields, body.encode())
    fields["WARC-Target-URI"] = arc.url
    if arc.fields["IP-address"] != "0.0.0.0":
        fields["WARC-IP-Address"] = arc.fields["IP-address"]
    head, payload = split_http(arc.block)
    fields["WARC-Payload-Digest"] = digest(payload)
    if not head:
        fields |= {"WARC-Type": "resource", "Content-Type": arc.fields["Content-type"]}
        return warc_record(fields, arc.block)
    fields["Content-Type"] = "application/http; msgtype=response"
    if original:
        fields |= {
            "WARC-Type": "revisit",
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": original[0],
            "WARC-Refers-To-Target-URI": original[1],
            "WARC-Refers-To-Date": original[2],
        }
        return warc_record(fields, head)
    return warc_record(fields | {"WARC-Block-Digest": digest(arc.block)}, arc.block)


def read_warc(raw: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a volume; a volume cut short raises EOFError."""
    src = gzip.GzipFile(fileobj=raw)
    while True:
        line = src.readline()
        while line == b"\r\n":
            line = src.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:200]!r}")
        fields = {}
        while (line := src.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k] = v.strip()
        length = int(fields["Content-Length"])
        block = src.read(length)
        if len(block) != length:
            raise EOFError(f"{fields.get('WARC-Record-ID')}: {len(block)} of {length} bytes")
        yield fields, block


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000") -> DataFrame:
    """ARC volumes of all pages in ``folder``, versions in turn; returns path, volume, records.

    A null html is an empty payload, a null URL is ``unknown:``; a null page_id is left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, parts, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{name}"
            put(path, lambda out: [out.write(x) for x in parts])
            return pa.RecordBatch.from_pydict({"path": [path], "volume": [name], "records": [n]})

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    version, name = 1 + (part + made) % 2, f"pages-{part:06d}-{made:04d}.arc.gz"
                    parts, size, n = [member(arc_opening(name, version, date))], 0, 0
                block = http_block(page_id, (html or "").encode())
                parts.append(member(arc_record(name, version, date, safe_url(url), block, size)))
                size, n = size + len(block), n + 1
                if size >= VOLUME_BYTES:
                    yield close()
                    parts, made = [], made + 1
        if parts:
            yield close()

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cut(spread(slim).mapInArrow(write, "path string, volume string, records long"), "arc-volumes")


def arc_records(volumes: DataFrame) -> DataFrame:
    """What the converter decides on: one row per record of the ARC volumes, payloads left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, volume in zip(*(batch.column(c).to_pylist() for c in ("path", "volume")), strict=True):
                rows = []
                with get(path) as raw:
                    for i, arc in enumerate(read_arc(raw)):
                        if i:
                            head, payload = split_http(arc.block)
                            own = header_value(head, "X-Page-Id")
                            rows.append((path, volume, i, own and int(own), arc.url, warc_date(arc.fields["Archive-date"]), len(payload), hashlib.sha1(payload).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = {"path": pa.string(), "volume": pa.string(), "index": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "date": pa.string(), "bytes": pa.int64(), "sha1": pa.string()}
    schema = pa.schema(list(kinds.items()))
    ddl = "path string, volume string, index long, page_id long, url string, date string, bytes long, sha1 string"
    return _one_by_one(volumes).mapInArrow(scan, ddl)


def _one_by_one(volumes: DataFrame) -> DataFrame:
    n = volumes.sparkSession.sparkContext.defaultParallelism
    return volumes.repartition(max(n, volumes.count() // 4))


def to_warc(volumes: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Convert ARC volumes to WARC volumes in ``folder``; returns path.

    Of records with equal payloads of at least ``least`` bytes, that with the largest page_id (then
    the last in the volumes' order) is a response and the others revisit it.
    """
    records = cut(arc_records(volumes), "arc-records")
    last = F.max(F.struct("page_id", "volume", "index", "url", "date")).alias("o")
    originals = records.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(last, F.count(F.lit(1)).alias("n"))
    originals = originals.where("n > 1").select("sha1", "bytes", "o")
    told = records.join(originals, ["sha1", "bytes"], "left").select(
        "path", "volume", "index", F.when((F.col("o.volume") != F.col("volume")) | (F.col("o.index") != F.col("index")), F.col("o")).alias("o")
    )

    def write(table: pa.Table) -> pa.Table:
        path, volume = table.column("path")[0].as_py(), table.column("volume")[0].as_py()
        seen = dict(zip(table.column("index").to_pylist(), table.column("o").to_pylist(), strict=True))
        name = volume.replace(".arc.gz", ".warc.gz")

        def records(out: BinaryIO) -> None:
            with get(path) as raw:
                for i, arc in enumerate(read_arc(raw)):
                    o = seen.get(i)
                    original = (warc_id(o["volume"], o["index"]), o["url"], o["date"]) if o else None
                    out.write(member(convert(arc, volume, i, original)))

        put(f"{folder}/{name}", records)
        return pa.table({"path": [f"{folder}/{name}"]})

    return cut(told.groupBy("volume").applyInArrow(write, "path string"), "warc-volumes")


def warc_records(volumes: DataFrame) -> DataFrame:
    """Responses and revisits of WARC volumes; a response's payload is checked against its digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with get(path) as raw:
                    for fields, block in read_warc(raw):
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        head, payload = split_http(block)
                        if fields["WARC-Type"] == "response" and digest(payload) != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
                        own, size = header_value(head, "X-Page-Id"), header_value(head, "Content-Length")
                        sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((own and int(own), int(size), sha1, fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "record_id": pa.string(), "refers_id": pa.string()}
    schema = pa.schema(list(kinds.items()))
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string"
    return _one_by_one(volumes).mapInArrow(scan, ddl)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC volumes say of each page.

    Every row of ``pages`` is a record of its own, also with a repeated or null page_id; other
    columns are not looked at. No pages, no rows.
    """
    arcs = write_arc(pages, scratch_path(spark, "arc"))
    found = cut(warc_records(to_warc(arcs, scratch_path(spark, "warc"))), "warc-records")
    originals = found.where("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to")
    )
    revisits = found.where("record_type = 'revisit'").join(originals, F.col("refers_id") == F.col("_id"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.select(*columns).unionByName(revisits.select(*columns))


SQL = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM w"""
