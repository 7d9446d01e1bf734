"""WARC records in ZIP-packaged archives, written and range-read.

An archive is a ZIP file whose members are stored, not compressed:
`archive/data.warc.gz`, one gzip member per WARC record, and
`indexes/index.cdxj`, one line per record with its offset and length there. The
writer streams records; it adds ZIP64 fields where sizes or offsets pass 32
bits. The reader opens an archive for random access and reads, in turn, its
tail (end record, ZIP64 locator and record if there), its central directory,
the local header of a member, the index, and then each record's own byte range.
Nothing is extracted.

Payloads that are equal and long enough are stored once: the row with the
largest id is a `response`, the others are `revisit` records that name it.
Digests are the bare upper-case base32 SHA-1 of the full payload.

Archives lie in the folder that spark.checkpoint.dir names, which all executors
share, and are opened by its URI. Each attempt at a task writes under a name of
its own, and only the names that successful tasks returned are read, so a lost
executor leaves at most an unread file. Every archive holds at most
ARCHIVE_BYTES of record data, and readers are dealt whole archives.

Defined results: a null payload is empty; rows with a null id take no part;
repeated ids with equal payloads each get a record and the same outcome; an
empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVE_BYTES = 64 << 20
WRITTEN = "path string, records long, bytes long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
LIMIT32 = 0xFFFFFFFF


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, kind: str, refers_to: int | None, payload: bytes, sha1: str, size: int) -> bytes:
    """One WARC/1.1 record; a revisit has headers only."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Bytes: {size}",
    ]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the payload of one WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) < n:
        raise ValueError("a WARC record is cut short")
    return fields, rest[:n]


class ZipWriter:
    """Stored members, one after another, onto a stream that can't seek.

    zip64 forces the long forms, which are otherwise used from 4 GiB on.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks) -> None:
        """The member's sizes and checksum follow its data, in a descriptor."""
        start, crc, size = self.at, 0, 0
        raw = name.encode()
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 8, 0, 0, 33, 0, 0, 0, len(raw), 0) + raw)
        for x in chunks:
            crc, size = zlib.crc32(x, crc), size + len(x)
            self._write(x)
        wide = self.zip64 or size > LIMIT32
        self._write(struct.pack("<IIQQ" if wide else "<IIII", 0x08074B50, crc, size, size))
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            wide = self.zip64 or max(size, at) > LIMIT32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            small, place = (LIMIT32, LIMIT32) if wide else (size, at)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 8, 0, 0, 33, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        end, n = self.at, len(self.members)
        if self.zip64 or end > LIMIT32 or n > 0xFFFF:
            self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, end - start, start))
            self._write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, LIMIT32, LIMIT32, 0))
        else:
            self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, end - start, start, 0))


class ZipReader:
    """Finds stored members by the central directory, and reads byte ranges of them."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail_at = max(0, size - 65_557)
        tail = self._range(tail_at, size - tail_at)
        k = tail.rfind(b"PK\x05\x06")
        if k < 0:
            raise ValueError("no ZIP directory")
        n, length, start = struct.unpack_from("<H", tail, k + 10)[0], *struct.unpack_from("<II", tail, k + 12)
        if n == 0xFFFF or length == LIMIT32 or start == LIMIT32:
            at = struct.unpack("<Q", self._range(tail_at + k - 12, 8))[0]
            record64 = self._range(at, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 directory")
            n, length, start = struct.unpack_from("<QQQ", record64, 32)
        self.members: dict[str, tuple[int, int]] = {}
        directory, p = self._range(start, length), 0
        for _ in range(n):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("a ZIP directory entry is broken")
            method, packed, whole, names, extras, notes = struct.unpack_from("<H", directory, p + 10)[0], *struct.unpack_from("<II", directory, p + 20), *struct.unpack_from("<HHH", directory, p + 28)
            at = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + names].decode()
            q, stop = p + 46 + names, p + 46 + names + extras
            while q + 4 <= stop:
                tag, n_bytes = struct.unpack_from("<HH", directory, q)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{n_bytes // 8}Q", directory, q + 4))
                    whole = wide.pop(0) if whole == LIMIT32 else whole
                    packed = wide.pop(0) if packed == LIMIT32 else packed
                    at = wide.pop(0) if at == LIMIT32 else at
                q += 4 + n_bytes
            if method == 0:
                self.members[name] = (at, packed)
            p = stop + notes

    def _range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def start(self, name: str) -> int:
        """Where a member's data begin, by its local header."""
        at, _ = self.members[name]
        head = self._range(at, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a ZIP member's header is broken")
        return at + 30 + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str) -> bytes:
        return self._range(self.start(name), self.members[name][1])

    def range(self, data_start: int, at: int, n: int) -> bytes:
        return self._range(data_start + at, n)


def _write_archive(out, rows, lines: list[str]) -> int:
    """Stream rows (id, url, payload, sha1, holder) into one archive; the index is kept in lines. Returns bytes of data."""
    writer, at = ZipWriter(out), 0

    def chunks():
        nonlocal at
        for page_id, url, payload, sha1, refers_to, size in rows:
            kind = "response" if refers_to is None else "revisit"
            data = gzip.compress(record(page_id, url, kind, refers_to, payload if refers_to is None else b"", sha1, size), 3, mtime=0)
            lines.append(f"{page_id} " + json.dumps({"offset": at, "length": len(data)}))
            at += len(data)
            yield data

    writer.member(DATA, chunks())
    writer.member(INDEX, ["\n".join(lines).encode()])
    writer.close()
    return at


def write(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives below path (a URI); one row per archive: path, records, bytes."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")).where(F.col("page_id").isNotNull())
    keyed = rows.withColumn("sha1", F.sha1("payload"))
    holders = keyed.where(F.length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("holder"))
    plan = keyed.join(holders, "sha1", "left").select(
        "page_id", "url", F.length("payload").cast("long").alias("size"), "sha1",
        F.when(F.col("holder") != F.col("page_id"), F.col("holder")).alias("refers_to"),
        F.when(F.coalesce(F.col("holder") == F.col("page_id"), F.lit(True)), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        todo = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(6))))
        pending = next(todo, None)
        while pending is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            lines: list[str] = []
            held = [0]

            def some():
                nonlocal pending
                while pending is not None and held[0] < ARCHIVE_BYTES:
                    page_id, url, size, sha1, refers_to, data = pending
                    held[0] += len(data) + 512
                    yield page_id, url, bytes(data), base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, size
                    pending = next(todo, None)

            with fs.open_output_stream(f"{root}/{name}") as out:
                n = _write_archive(out, some(), lines)
            yield pa.record_batch([pa.array([f"{path}/{name}"]), pa.array([len(lines)], pa.int64()), pa.array([n], pa.int64())], names=["path", "records", "bytes"])

    return plan.mapInArrow(run, WRITTEN)


def read_archive(source) -> Iterator[tuple]:
    """Every record of one archive, by its index: id, size, digest, kind, holder, url, payload."""
    z = ZipReader(source)
    start = z.start(DATA)
    for line in z.read(INDEX).decode().splitlines():
        place = json.loads(line.split(" ", 1)[1])
        fields, payload = parsed(gzip.decompress(z.range(start, place["offset"], place["length"])))
        kind, sha1 = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != sha1:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
        number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
        refers = fields.get("WARC-Refers-To")
        yield number(fields["WARC-Record-ID"]), int(fields["X-Payload-Bytes"]), sha1, kind, number(refers) if refers else None, fields["WARC-Target-URI"], payload if kind == "response" else None


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (a frame with their paths): page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    rows, held = [], 0
                    for r in read_archive(source):
                        rows.append(r)
                        held += len(r[-1] or b"") + 200
                        if held > 4 << 20:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.select("path").mapInArrow(run, READ)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in scratch, then read the records back."""
    spark = pages.sparkSession
    base = folder(spark)
    manifest = write(pages, f"{base}/archives", least)
    manifest.write.mode("overwrite").parquet(f"{base}/manifest")
    archives = spark.read.schema(WRITTEN).parquet(f"{base}/manifest")
    return read(archives.repartition(max(1, 2 * spark.sparkContext.defaultParallelism)))


def in_memory(data: bytes):
    """A reader over bytes, for tests and small archives."""
    return ZipReader(pa.BufferReader(io.BytesIO(data).getvalue()))
