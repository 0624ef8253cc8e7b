"""WARC archives: a writer and a sequential reader.

One gzip member per record.  The reader inflates a stream piece by piece with
zlib, frames each block by its Content-Length and checks block and payload
digests as the bytes go by, so it never holds more than one piece of a record
unless payloads are asked for.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_path, text_or_empty

PIECE = 1 << 18
#: Payloads of fewer bytes are never replaced by a revisit record.
MIN_REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long"


class WarcError(ValueError):
    """A record that breaks the format or fails a digest."""


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_of(label: str) -> str:
    """Hex form of a ``sha1:BASE32`` label."""
    kind, _, value = label.partition(":")
    if kind.lower() != "sha1":
        raise WarcError(f"unknown digest {label!r}")
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def record_bytes(record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record, not yet compressed.  A revisit keeps the HTTP header of the
    response, which tells the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {_clean(uri)}",
        f"WARC-Payload-Digest: {sha1_label(payload)}",
        f"WARC-Block-Digest: {sha1_label(block)}",
    ]
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_sha1: str = ""
    payload: bytes | None = None

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def record_id(self) -> str:
        return self.headers["warc-record-id"].strip("<>")


class _Member:
    """Reads the members of a gzip file one after the other."""

    def __init__(self, raw):
        self.raw, self.rest, self.z, self.buffer = raw, b"", None, bytearray()

    def begin(self) -> bool:
        """Whether another member follows."""
        if self.buffer:
            raise WarcError("bytes after the end of a record")
        if not self.rest:
            self.rest = self.raw.read(PIECE)
        if not self.rest:
            return False
        self.z = zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        """Inflate one more piece of this member; False at its end."""
        while not self.z.eof:
            if self.z.unconsumed_tail:
                data = self.z.unconsumed_tail
            else:
                data, self.rest = self.rest or self.raw.read(PIECE), b""
                if not data:
                    raise WarcError("the file ends inside a member")
            got = self.z.decompress(data, PIECE)
            if self.z.eof:
                self.rest = self.z.unused_data
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        start = 0
        while (at := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if len(self.buffer) > most or not self.more():
                raise WarcError("a header without end")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.buffer and not self.more():
                raise WarcError("a block is shorter than its Content-Length")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            yield piece


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise WarcError(f"not a header line: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(raw, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an open binary file, in order."""
    member = _Member(raw)
    while member.begin():
        head = member.until(b"\r\n\r\n").split(b"\r\n")
        if not head[0].startswith(b"WARC/"):
            raise WarcError(f"no WARC record: {head[0][:20]!r}")
        record = Record(_fields(head[1:]))
        left = int(record.headers["content-length"])
        block, payload = hashlib.sha1(), hashlib.sha1()
        http, in_http, kept = bytearray(), "application/http" in record.headers.get("content-type", ""), []
        for piece in member.take(left):
            block.update(piece)
            if in_http:
                http += piece
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                record.http = _fields(bytes(http[:at]).split(b"\r\n")[1:])
                piece, in_http = bytes(http[at + 4 :]), False
            payload.update(piece)
            record.payload_bytes += len(piece)
            if keep_payload:
                kept.append(piece)
        if b"".join(member.take(4)) != b"\r\n\r\n" or member.buffer or member.more():
            raise WarcError(f"{record.record_id}: a record doesn't end where its Content-Length says")
        if (said := record.headers.get("warc-block-digest")) and hex_of(said) != block.hexdigest():
            raise WarcError(f"{record.record_id}: block digest differs")
        record.payload_sha1 = payload.hexdigest()
        said = record.headers.get("warc-payload-digest")
        if record.kind == "revisit":
            record.payload_bytes, record.payload_sha1 = int(record.http["content-length"]), hex_of(said)
        else:
            if said and hex_of(said) != record.payload_sha1:
                raise WarcError(f"{record.record_id}: payload digest differs")
            if keep_payload:
                record.payload = b"".join(kept)
        yield record


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive per task, under a name no other attempt uses; only names that
    a finished task has returned are part of the result."""
    fs, path = file_system(folder)
    name, out, n, size = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
    for batch in batches:
        if out is None and batch.num_rows:
            fs.create_dir(path, recursive=True)
            out = fs.open_output_stream(f"{path}/{name}")
        for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
            page, refers = page.as_py(), refers.as_py()
            data = gzip_member(
                record_bytes(
                    f"urn:timeloom:page:{'' if page is None else page}",
                    url.as_py() or "",
                    html.as_py().encode("utf-8"),
                    None if refers is None else f"urn:timeloom:page:{refers}",
                )
            )
            out.write(data)
            n, size = n + 1, size + len(data)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; returns
    the written manifest (file, records, bytes).

    Of the pages with equal payloads of ``MIN_REVISIT_BYTES`` or more, the one
    with the largest id is the response.  Payloads are equal when length and
    SHA-256 are.  Groups are found on digests alone (a partial maximum per task,
    then a join that adaptive execution can split), so a payload with very many
    copies gathers nowhere; html moves once, keyed by page.  Several rows that
    share the largest id, and rows with a null id, are responses all.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    digest = F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    long = rows.filter((F.octet_length("html") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", digest.alias("digest"))
    first = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).filter("low < refers_to").drop("low")
    revisits = long.join(first, "digest").filter("page_id < refers_to").distinct()
    sent = (
        rows.withColumn("digest", F.when(F.octet_length("html") >= MIN_REVISIT_BYTES, digest))
        .join(revisits, ["page_id", "digest"], "left")
        .select("page_id", "url", "html", "refers_to")
    )
    made = sent.mapInArrow(lambda it, f=folder: _write(f, it), MANIFEST)
    return materialise(made, "warc-manifest")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _page(record_id: str) -> int | None:
    number = record_id.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def _read(folder: str, keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    fs, path = file_system(folder)
    for batch in batches:
        for name in batch.column("file").to_pylist():
            rows, held = [], 0
            with fs.open_input_stream(f"{path}/{name}") as f:
                for r in read_records(io.BufferedReader(f, PIECE) if not hasattr(f, "read") else f, keep):
                    refers = r.headers.get("warc-refers-to")
                    rows.append((_page(r.record_id), r.payload_bytes, r.payload_sha1, r.kind, _page(refers) if refers else None, r.payload))
                    held += len(r.payload or b"")
                    if len(rows) >= 2000 or held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Read the archives that ``manifest`` lists, one file per task at a time.

    A damaged member, a wrong length or digest raises :class:`WarcError`.
    """
    spark = manifest.sparkSession
    files = manifest.select("file").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    out = files.mapInArrow(lambda it, f=folder, k=payloads: _read(f, k, it), READ)
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, one row per input row.

    A null html has the empty payload; an empty table gives an empty result."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
