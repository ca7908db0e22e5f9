"""WARC archives: monolithic gzip writer, normaliser, offset index, reader.

1. ``write_archives``: each task streams its records into archives that are one
   gzip member each (the monolithic form to be normalised), rolling to a new
   file at ``roll_bytes``; names carry the task attempt, and only files named in
   the committed manifest count, so a retried task leaves no double records.
2. ``normalise``: inflates each archive once as a stream, rewrites every record
   as its own gzip member, and writes a sidecar index of (offset, length).
3. ``read_records``: reads single members by the index.

Files go to a folder under ``spark.checkpoint.dir`` (or one given): a shared
mount is opened directly, any other scheme through ``pyarrow.fs``.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import written
from eventlake.streaming.common import run_dir

ROLL_BYTES = 64 << 20
CHUNK = 1 << 18
_MANIFEST = "path string, records bigint"
_INDEX = "path string, offset bigint, length bigint, record_id string, record_type string, target_uri string"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return pafs.LocalFileSystem(), u.path
    return pafs.FileSystem.from_uri(uri)


def _open_write(uri: str):
    fs, path = _fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return fs.open_output_stream(path, compression=None)


def _open_read(uri: str):
    fs, path = _fs(uri)
    return fs.open_input_file(path)


def _clean(value: str) -> str:
    """A header value on one line (control characters percent-encoded)."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record_bytes(page_id, url: str | None, payload: bytes, size: int, sha1: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def classify(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url",
             payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) per page.

    Of equal payloads of at least ``min_bytes`` the largest id is the response.
    The groups come from hashes with map-side combining; the payload itself is
    shuffled once at most, by page id, which no group of copies can make hot.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    large = base.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_bytes", "payload_digest")
    best = (large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
            .where((F.col("n") > 1) & F.col("keep").isNotNull()).drop("n"))
    revisits = (large.join(best, ["payload_digest", "payload_bytes"])
                .where(~F.col("page_id").eqNullSafe(F.col("keep")))
                .select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"), "payload_digest", F.col("keep").alias("refers_to"))
                .distinct())
    return (base.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
            .join(revisits, ["key", "payload_digest"], "left").drop("key"))


class _Archive:
    """A monolithic .warc.gz: one gzip stream over all its records."""

    def __init__(self, uri: str) -> None:
        self.uri, self.records, self.size = uri, 0, 0
        self.out = _open_write(uri)
        self.zip = zlib.compressobj(6, zlib.DEFLATED, 31)

    def add(self, rec: bytes) -> None:
        self.out.write(self.zip.compress(rec))
        self.records += 1
        self.size += len(rec)

    def close(self) -> tuple[str, int]:
        self.out.write(self.zip.flush())
        self.out.close()
        return self.uri, self.records


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the records; return the committed manifest (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, arc = uuid.uuid4().hex, [], None
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")]
            for row in zip(*(c for c in cols), strict=True):
                rec = record_bytes(*(v.as_py() for v in row))
                if arc is None:
                    arc = _Archive(f"{folder}/raw/{part}-{len(done):05d}.warc.gz")
                arc.add(rec)
                if arc.size >= roll_bytes:
                    done.append(arc.close())
                    arc = None
        if arc is not None:
            done.append(arc.close())
        if done:
            yield pa.RecordBatch.from_pylist([{"path": p, "records": n} for p, n in done],
                                             schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return written(records.mapInArrow(run, _MANIFEST), "warc-manifest")


def inflate(uri: str) -> Iterator[bytes]:
    """The whole file as one stream of plain bytes (several members also work)."""
    with _open_read(uri) as f:
        z = zlib.decompressobj(31)
        while data := f.read(CHUNK):
            while data:
                yield z.decompress(data)
                if not z.eof:
                    break
                data, z = z.unused_data, zlib.decompressobj(31)


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Cut a plain WARC stream into records by their Content-Length."""
    buf = bytearray()
    need = None
    for piece in stream:
        buf += piece
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    break
                m = re.search(rb"\r\nContent-Length:[ \t]*([0-9]+)", bytes(buf[:end]), re.I)
                if not m:
                    raise ValueError("WARC record without Content-Length")
                need = end + 4 + int(m.group(1)) + 4
            if len(buf) < need:
                break
            yield bytes(buf[:need])
            del buf[:need]
            need = None
    if buf.strip():
        raise ValueError("truncated WARC record")


def headers(record: bytes) -> dict[str, str]:
    head = record[:record.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head)}


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of the manifest with one member per record and a
    sidecar ``.idx``; return the index rows (one per record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = f"{folder}/members/{os.path.basename(path)[:-8]}-{uuid.uuid4().hex[:8]}.warc.gz"
                rows, offset = [], 0
                with _open_write(target) as out:
                    for rec in split_records(inflate(path)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        out.write(member)
                        h = headers(rec)
                        rows.append({"path": target, "offset": offset, "length": len(member), "record_id": h["warc-record-id"],
                                     "record_type": h["warc-type"], "target_uri": h.get("warc-target-uri", "")})
                        offset += len(member)
                with _open_write(f"{target}.idx") as idx:
                    idx.write("".join(f"{r['offset']} {r['length']} {r['record_type']} {r['record_id']} {r['target_uri']}\n" for r in rows).encode())
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                        ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
                        ("record_type", pa.string()), ("target_uri", pa.string())]))

    # archives hold roll_bytes each: deal the (thin) list out so that every task gets a few of them
    spread = manifest.repartition(max(1, manifest.count()), "path")
    return written(spread.mapInArrow(run, _INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Read members by offset: ``record_id, record_type, refers_to_id, payload,
    payload_digest`` (payload null for a revisit; digest as the header says,
    verified against the payload of a response)."""
    ddl = "record_id string, record_type string, refers_to_id string, payload binary, payload_digest string, payload_bytes bigint"
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()),
                        ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = None
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if source is None or source[0] != path:
                    if source is not None:
                        source[1].close()
                    source = (path, _open_read(path))
                source[1].seek(offset)
                rec = zlib.decompress(source[1].read(length), 31)
                h = headers(rec)
                body = rec[rec.index(b"\r\n\r\n") + 4:-4]
                http, _, payload = body.partition(b"\r\n\r\n")
                size = int(re.search(rb"\r\nContent-Length:[ \t]*([0-9]+)", http, re.I).group(1))
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                revisit = h["warc-type"] == "revisit"
                if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {h['warc-record-id']} does not match its header")
                rows.append({"record_id": h["warc-record-id"], "record_type": h["warc-type"], "refers_to_id": h.get("warc-refers-to"),
                             "payload": None if revisit else payload, "payload_digest": digest, "payload_bytes": size})
                held += len(payload)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if source is not None:
            source[1].close()

    return index.mapInArrow(run, ddl)


def archive_round_trip(pages: DataFrame, min_bytes: int = 1000, folder: str | None = None,
                       roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write, normalise and read back; one row per page record:
    ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload``.

    Null html counts as empty; a null url is written as empty; a null page id
    stays null and never becomes a response that others refer to; repeated
    rows give a record each (equal ones with the largest id are all responses);
    other columns are ignored; an empty table writes nothing.
    """
    folder = folder or run_dir(pages.sparkSession, "warc")
    records = classify(pages, min_bytes)
    manifest = write_archives(records, folder, roll_bytes)
    index = normalise(manifest, folder)
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast(pages.schema["page_id"].dataType)
    return read_records(index).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number(F.col("refers_to_id")).alias("refers_to"), "payload")
