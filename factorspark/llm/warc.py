"""Operator 7: legacy archive converter, from ARC files to WARC files and back from these.

ARC record headers of version 1 and 2 are parsed by their own field lists and declared lengths; equivalent WARC
identifiers, timestamps, types and digests are synthesised. Archives are written with Spark's text writer: a line is a
stretch of whole records of bounded bytes, its separator the end of a WARC record, and a file has a few lines.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm.common import WRITTEN, map_batches, materialize, shared_dir, table

# Fixed values of the ARC format: the field lists of a version's record header lines.
FIELDS = {
    b"1": ("url", "ip", "date", "mime", "length"),
    b"2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
LEAST_REVISIT = 100
#: Bytes of a stretch (a longer record is one alone) and stretches of a file.
STRETCH_BYTES, STRETCHES = 4 << 20, 8
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 9562
RECORD_END = "\r\n\r\n"

RECORD_SCHEMA = "version string, url string, ip string, date string, mime string, status string, truncated boolean, type string, record_id string, http binary, payload binary, payload_bytes long, payload_digest string"


def parse_arc(blob: bytes) -> Iterator[dict]:
    """The records of one ARC file after its version block, which decides how header lines are read.

    URLs may hold spaces: fields are taken from the line's right. A length that runs over the end gives what is
    there, marked truncated; lines that are no header are skipped. An empty file gives nothing.
    """
    version, at = b"1", 0
    while at < len(blob):
        stop = blob.find(b"\n", at)
        stop = len(blob) if stop < 0 else stop
        line, begin = blob[at:stop].strip(b"\r"), stop + 1
        if line.startswith(b"filedesc:"):
            fields = line.rsplit(b" ", 4)
            try:
                size = int(fields[-1])
            except ValueError:
                at = begin
                continue
            version = blob[begin : begin + size].split(b" ", 1)[0].strip()
            version = version if version in FIELDS else b"1"
            at = begin + size
            continue
        names = FIELDS[version]
        parts = line.rsplit(b" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            at = begin
            continue
        rec = {n: p.decode("utf-8", "replace") for n, p in zip(names, parts, strict=True)}
        size = int(parts[-1])
        rec |= {"version": version.decode(), "content": blob[begin : begin + size], "truncated": begin + size > len(blob)}
        yield rec
        at = begin + size


def warc_date(arc_date: str) -> str:
    """ARC's 14 (or 12) digits as WARC's ISO form; anything else is the epoch."""
    d = arc_date if re.fullmatch(r"\d{14}", arc_date) else arc_date + "00" if re.fullmatch(r"\d{12}", arc_date) else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def convert(rec: dict) -> dict:
    """An ARC record's WARC equivalents. Content with an HTTP status line is a response, else a resource."""
    content = rec["content"]
    http, payload, kind = b"", content, "resource"
    if content.startswith(b"HTTP/"):
        m = re.search(rb"\r?\n\r?\n", content)
        kind, http, payload = ("response", content[: m.end()], content[m.end() :]) if m else ("response", content, b"")
    digest = hashlib.sha256(payload).hexdigest()
    name = f"{rec['url']} {rec['date']} {hashlib.sha256(content).hexdigest()}"
    return {
        "version": rec["version"], "url": rec["url"], "ip": rec["ip"], "date": warc_date(rec["date"]), "mime": rec["mime"], "status": rec.get("status"), "truncated": rec["truncated"],
        "type": kind, "record_id": f"<urn:uuid:{uuid.uuid5(_IDS, name)}>", "http": http, "payload": payload, "payload_bytes": len(payload), "payload_digest": digest,
    }


def _batches(rows: Iterable[dict], schema: pa.Schema, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, bytes | str)) + 64
        if size >= most_bytes:
            yield pa.RecordBatch.from_pylist(some, schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=schema)


_ARROW = pa.schema([(n, {"string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()}[k]) for n, k in (x.split() for x in RECORD_SCHEMA.split(", "))])


def convert_arcs(arcs: DataFrame, content_col: str = "content") -> DataFrame:
    """One row of RECORD_SCHEMA for each record of ARC files, one file a row; null and empty files give nothing, repeated
    files their records again; other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((convert(r) for b in batches for x in b.column(0) for r in parse_arc(x.as_py() or b"")), _ARROW)

    return map_batches(arcs.select(content_col), run, RECORD_SCHEMA)


def mark_revisits(records: DataFrame, key: str, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """Adds refers_to and refers_id: of records with equal payloads of at least least_bytes the smallest key and its
    record id, on all others.

    The smallest keys are partial aggregates, kept only for digests that repeat; the join back is a plain
    sort-merge join, whose skewed side (a payload that a third of the records share) adaptive execution splits.
    A null key is never referred to and refers to nothing if it is alone.
    """
    long_ = F.col("payload_bytes") >= least_bytes
    firsts = records.where(long_ & F.col(key).isNotNull()).groupBy("payload_digest").agg(F.min(F.struct(F.col(key).alias("k"), "record_id")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts = materialize(firsts.select("payload_digest", F.col("first.k").alias("first_key"), F.col("first.record_id").alias("first_id")), "warc-firsts")
    joined = records.join(firsts, "payload_digest", "left")
    refers = F.when(long_ & F.col("first_key").isNotNull() & ~F.col(key).eqNullSafe(F.col("first_key")), F.col("first_key"))
    return joined.withColumn("refers_to", refers).withColumn("refers_id", F.when(F.col("refers_to").isNotNull(), F.col("first_id"))).drop("first_key", "first_id")


def _record(r: dict) -> bytes:
    """A WARC/1.1 record without its end, which the writer adds. A revisit keeps the HTTP header alone."""
    revisit = r["refers_to"] is not None
    block = r["http"] if revisit else r["http"] + r["payload"]
    head = [
        ("WARC-Type", "revisit" if revisit else r["type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
        ("Content-Type", "application/http; msgtype=response" if r["http"] else r["mime"]), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"), ("X-Payload-Length", str(r["payload_bytes"])),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Key", str(r["refers_to"]))]
        head.append(("WARC-Refers-To", r["refers_id"]))
    if r["truncated"]:
        head.append(("WARC-Truncated", "length"))
    head.append(("Content-Length", str(len(block))))
    clean = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v or '')}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{clean}\r\n".encode() + block


def _info(first: dict) -> bytes:
    """The warcinfo record of the file that begins with this record: the same whenever the file is written anew."""
    body = b"software: factorspark\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(_IDS, f"warcinfo {first['record_id']}")
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records (RECORD_SCHEMA, refers_to and refers_id) as gzipped WARC files into the folder path.

    Files are cut by bytes: STRETCHES stretches of some STRETCH_BYTES, each file with a warcinfo record first. No records give
    files without any; repeated records are written again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = n = 0

        def line() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join(parts)], pa.binary())], names=["r"])

        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(names)}
                if not parts and n % STRETCHES == 0:
                    parts.append(_info(r))
                parts.append(_record(r))
                size += len(parts[-1])
                if size >= STRETCH_BYTES:
                    yield line()
                    parts, size, n = [], 0, n + 1
        if parts:
            yield line()

    lines = map_batches(records, run, "r binary").select(F.col("r").cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", STRETCHES).text(path)


READ_SCHEMA = "record_id string, record_type string, url string, date string, refers_to string, http binary, payload binary, payload_bytes long, payload_digest string"
_READ = pa.schema([(n, {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[k]) for n, k in (x.split() for x in READ_SCHEMA.split(", "))])


def parse_warc(stream: io.BufferedIOBase, with_payload: bool = True) -> Iterator[dict]:
    """Response, resource and revisit records of a WARC stream; digests and lengths are computed from the bytes read, a revisit's taken from its header."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline()) and line.strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head.get("content-length", 0)))
        kind = head.get("warc-type", "")
        if kind not in ("response", "resource", "revisit"):
            continue
        http, payload = b"", block
        if head.get("content-type", "").startswith("application/http"):
            m = re.search(rb"\r?\n\r?\n", block)
            http, payload = (block[: m.end()], block[m.end() :]) if m else (block, b"")
        declared = head.get("warc-payload-digest", "").removeprefix("sha256:")
        if kind == "revisit":
            size, digest = int(head.get("x-payload-length", 0)), declared
        else:
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if declared and declared != digest:
                raise ValueError(f"{head.get('warc-record-id')}: the payload doesn't match its digest")
        yield {"record_id": head.get("warc-record-id"), "record_type": kind, "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": head.get("x-refers-to-key"), "http": http, "payload": payload if with_payload else None, "payload_bytes": size, "payload_digest": digest}


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of READ_SCHEMA from the WARC files (gzipped or plain) of a folder. A file is a row of bytes, as write_warc bounds
    them, and is expanded record by record. A folder without records gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for x in b.column(0):
                    raw = pa.BufferReader(x.as_buffer())  # no copy of the file
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    yield from parse_warc(gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw), with_payload)

        yield from _batches(rows(), _READ)

    return map_batches(spark.read.format("binaryFile").load(path).select("content"), run, READ_SCHEMA)


# -- the query: pages as ARC files of both versions, converted, written and read ----------------------------------


def arcs_of_pages(pages: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """(content): ARC files of about most_bytes, of version 1 and 2 in turn. The page id is an HTTP header; null html is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = n = 0

        def begin(version: int) -> bytes:
            names = " ".join({1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"), 2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}[version])
            block = f"{version} 0 factorspark\n{names}\n\n".encode()
            return f"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain {len(block)}\n".encode() + block

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html = (batch.column(k)[i].as_py() for k in range(3))
                payload = (html or "").encode()
                content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if page is None else b"X-Page-Id: %d\r\n" % page) + b"\r\n" + payload
                url = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page}")
                if not parts:
                    n += 1
                    parts.append(begin(2 - n % 2))
                more = "" if n % 2 else f" 200 {hashlib.md5(payload).hexdigest()} - {size} pages.arc"
                parts.append(f"{url} 0.0.0.0 {20000101000000 + (page or 0) % 60} text/html{more} {len(content)}\n".encode() + content + b"\n")
                size += len(parts[-1])
                if size >= most_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    return map_batches(pages.select("page_id", "url", "html"), run, "content binary")


def page_key(http: str = "http"):
    return F.nullif(F.regexp_extract(F.col(http).cast("string"), r"X-Page-Id: (-?\d+)", 1), F.lit("")).cast("long")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all pages, read back from the archives. Null html is
    empty, a null page_id is never referred to; repeated rows get a row each, of which all with the smallest id are responses."""
    records = convert_arcs(arcs_of_pages(table(spark, sf_dir, "pages"))).withColumn("key", page_key())
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(mark_revisits(records, "key").drop("key"), path)
    WRITTEN.append(path)
    back = read_warc(spark, path, with_payload=False)
    return back.select(page_key().alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""
