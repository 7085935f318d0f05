"""WARC records in ZIP archives: written by tasks, located by the archives' own directories, read by ranges.

An archive is a ZIP file of stored (uncompressed) members: `archive/data.warc.gz`, with one gzip member a record, and
`indexes/index.jsonl`, with a line for each record's place. A reader parses the end record, the ZIP64 records where
there are any, and the central directory, and then reads only the bytes it wants; nothing is extracted.

Files go through pyarrow's file systems to the shared folder of the session. Each attempt of a task writes under names
of its own, and only archives that the manifest lists are read, so a repeated task does no harm.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexweave.storage import cut, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Bytes of records after which a task begins another archive; a larger record has one of its own.
ARCHIVE_BYTES = 16 << 20
#: Bytes of one range read, unless a record is larger.
READ_BYTES = 2 << 20
REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


# ZIP directories


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def members(file, size: int) -> dict[str, Member]:
    """The members that the central directory of an open file (with read_at(n, offset)) lists."""
    tail_at = max(0, size - 65557)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        if end < 20 or tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record = file.read_at(56, at)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = file.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a damaged central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, full = struct.unpack_from("<II", directory, at + 20)
        name_n, extra_n, note_n = struct.unpack_from("<HHH", directory, at + 28)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8", "replace")
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # 64-bit values, only of the fields that overflow, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        found[name] = Member(name, method, packed, header)
        at += 46 + name_n + extra_n + note_n
    return found


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed, so its records have no places")
    header = file.read_at(30, member.header)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    name_n, extra_n = struct.unpack_from("<HH", header, 26)
    return member.header + 30 + name_n + extra_n


# Records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record without it; both say the full payload's size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says; of a response, size and digest are taken from the payload itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = fields["WARC-Record-ID"][10:-1]
    out = {"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI", ""), "record_type": fields["WARC-Type"], "refers_to": None}
    if out["record_type"] == "revisit":
        return out | {"refers_to": int(fields["WARC-Refers-To"][10:-1]), "payload": None, "payload_bytes": said, "payload_digest": digest}
    own = hashlib.sha1(payload).hexdigest()
    if own != digest or len(payload) != said:
        raise ValueError(f"page {page}: its payload differs from its digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": own}


# Spark jobs


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of REVISIT_BYTES and more, the largest page_id stays.

    Null html is empty. Rows that repeat that page_id with that payload all stay; a null page_id revisits like others.
    Groups that repeat are counted first, so that the join's other side is those groups alone.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    large = rows.filter(F.octet_length("html") >= REVISIT_BYTES)
    groups = cut(large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    marked = rows.join(groups, "digest", "left")
    return marked.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of the archives in `folder`, a URI that pyarrow's file systems know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        data, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                z.writestr(zipfile.ZipInfo(DATA), data.getbuffer())
                z.writestr(zipfile.ZipInfo(INDEX), "".join(index))
            name = f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(out.getbuffer())
            done = pa.RecordBatch.from_pydict({"path": [name], "records": [len(index)], "bytes": [out.tell()]})
            data.seek(0)
            data.truncate()
            index.clear()
            return done

        for whole in batches:
            for b in (whole.slice(lo, 200) for lo in range(0, whole.num_rows, 200)):
                for page_id, url, html, digest, refers_to in zip(*(b.column(i).to_pylist() for i in range(5))):
                    z = zlib.compressobj(3, zlib.DEFLATED, 31)
                    packed = z.compress(record(page_id, url, html.encode(), digest, refers_to)) + z.flush()
                    if index and data.tell() + len(packed) > ARCHIVE_BYTES:
                        yield close()
                    index.append(json.dumps({"page_id": page_id, "digest": digest, "offset": data.tell(), "length": len(packed)}) + "\n")
                    data.write(packed)
        if index:
            yield close()

    return marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")


def locate(archives: DataFrame, folder: str) -> DataFrame:
    """(path, start, places) of ranges of whole records, from the archives' directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    found = members(f, f.size())
                    base, at = data_offset(f, found[DATA]), data_offset(f, found[INDEX])
                    lines = f.read_at(found[INDEX].size, at).splitlines()
                ranges: list[tuple[int, list[int]]] = []
                for line in lines:
                    x = json.loads(line)
                    if not ranges or x["offset"] + x["length"] - ranges[-1][1][0] > READ_BYTES:
                        ranges.append((base + x["offset"], [x["offset"]]))
                    ranges[-1][1].append(x["offset"] + x["length"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ranges)), pa.array([r[0] for r in ranges], pa.int64()), pa.array([[p - r[1][0] for p in r[1]] for r in ranges], pa.list_(pa.int64()))], names=["path", "start", "places"]
                )

    return archives.select("path").mapInArrow(run, "path string, start long, places array<long>")


def read_records(ranges: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each record of the ranges."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start, places in zip(*(b.column(i).to_pylist() for i in range(3))):
                with fs.open_input_file(f"{root}/{name}") as f:
                    raw = f.read_at(places[-1], start)
                rows = [parse(zlib.decompress(raw[lo:hi], 31)) for lo, hi in zip(places, places[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return ranges.select("path", "start", "places").mapInArrow(run, ddl)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every row written to archives in the shared folder, and what reading them back gives."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    archives = cut(write_archives(mark_revisits(pages), folder))
    tasks = max(1, archives.count())  # an archive's worth of ranges each, however few bytes their places take
    return read_records(locate(archives, folder).repartition(tasks, "path", "start"), folder, with_payload)
