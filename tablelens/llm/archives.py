"""WARC records in ZIP-packaged archives: a writer, and a reader that reads ranges.

The writer puts one WARC record per row into archives below a shared folder.
Every task fills archives of about ``ROLL`` bytes: a ZIP file with two *stored*
members, ``archive/data.warc`` (the records) and ``indexes/index.tsv`` (offset
and length of each record).  Payloads of at least ``LEAST`` bytes that occur
more than once are written once, with the row of the largest id as response;
the others are revisit records without payload.

The reader takes archive paths as rows.  It reads the end of the file for the
end-of-central-directory record (and its ZIP64 form), reads the central
directory, finds the stored members through their local headers, reads the
index, and then reads each record as a byte range.  Nothing is extracted, and
no more than one record is in memory.  Files are opened through pyarrow's file
systems (local, HDFS, S3), so paths may be URIs.

Archives have names of their own for every attempt; only those of successful
tasks are listed, in a table, and read.  Null html is an empty payload.  Rows
with a null id are written with an empty id and read as null; among equal
payloads the largest id is the response, and every row with that id (all rows,
if no id is known) is one.  Other columns never matter.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.common import stored
from tablelens.session import scratch_path

LEAST = 1000
ROLL = 32 << 20
BROADCAST_ROWS = 100_000
DATA, INDEX = "archive/data.warc", "indexes/index.tsv"
_END, _END64, _FIND64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL = 0xFFFFFFFF


def _open(path: str):
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return system, inner


# ---------------------------------------------------------------- ZIP files


@dataclass(frozen=True)
class Member:
    """A stored member: where its bytes are in the archive."""

    name: str
    start: int
    size: int
    crc: int


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """Pieces of a ZIP file of stored members; ZIP64 records where sizes need them (or ``zip64``)."""
    at, entries = 0, []
    for name, data in members:
        raw, crc, big = name.encode(), zlib.crc32(data), zip64 or len(data) >= _FULL
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = _FULL if big else len(data)
        head = struct.pack("<4sHHHHHIIIHH", _LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        entries.append((raw, crc, len(data), at))
        yield head
        yield data
        at += len(head) + len(data)
    start = at
    for raw, crc, length, offset in entries:
        big = zip64 or max(length, offset) >= _FULL
        extra = struct.pack("<HHQQQ", 1, 24, length, length, offset) if big else b""
        size, where = (_FULL, _FULL) if big else (length, offset)
        entry = struct.pack("<4sHHHHHHIIIHHHHHII", _ENTRY, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra
        at += len(entry)
        yield entry
    n, length = len(entries), at - start
    if zip64 or start >= _FULL or n >= 0xFFFF:
        yield struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, length, start)
        yield struct.pack("<4sIQI", _FIND64, 0, at, 1)
        yield struct.pack("<4sHHHHIIH", _END, 0, 0, 0xFFFF, 0xFFFF, _FULL, _FULL, 0)
    else:
        yield struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, length, start, 0)


def read_members(source, size: int) -> dict[str, Member]:
    """The stored members of a ZIP file, by reading its directory only.

    ``source`` has ``read_at(length, offset)``.  Compressed or encrypted members are refused.
    """
    tail_at = max(0, size - 66_000)  # a comment has at most 65,535 bytes
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(_END, 0, max(0, len(tail) - 18))  # the record has at least 22 bytes
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if n == 0xFFFF or length == _FULL or start == _FULL:
        find = tail_at + end - 20
        mark, _, end64, _ = struct.unpack("<4sIQI", source.read_at(20, find))
        if mark != _FIND64:
            raise ValueError("ZIP64 locator missing")
        record = source.read_at(56, end64)
        if record[:4] != _END64:
            raise ValueError("ZIP64 end of central directory missing")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = source.read_at(length, start), 0, {}
    for _ in range(n):
        mark, _, _, flags, method, _, _, crc, packed, plain, names, extras, comment, _, _, _, offset = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, at)
        if mark != _ENTRY:
            raise ValueError("broken central directory")
        name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, at = directory[at + 46 + names : at + 46 + names + extras], at + 46 + names + extras + comment
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain = next(values) if plain == _FULL else plain
                packed = next(values) if packed == _FULL else packed
                offset = next(values) if offset == _FULL else offset
            extra = extra[4 + width :]
        if method or flags & 1 or packed != plain:
            raise ValueError(f"member {name} is not stored")
        local = source.read_at(30, offset)
        if local[:4] != _LOCAL:
            raise ValueError(f"local header of {name} missing")
        names, extras = struct.unpack_from("<HH", local, 26)
        found[name] = Member(name, offset + 30 + names + extras, plain, crc)
    return found


# ------------------------------------------------------------- WARC records


def record_bytes(key: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key + ' ' + digest)}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {key}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


_MANIFEST = "path string, records long, bytes long"


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _open(folder)
        system.create_dir(inner, recursive=True)
        data, index, attempt, part, size = [], [], uuid.uuid4().hex, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal part, size
            name = f"part-{attempt}-{part:05d}.wacz"
            written = 0
            with system.open_output_stream(f"{inner}/{name}") as out:
                for piece in zip_bytes([(DATA, b"".join(data)), (INDEX, "".join(index).encode())]):
                    written += out.write(piece) or len(piece)
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)]), pa.array([written])], names=["path", "records", "bytes"])
            data.clear(), index.clear()
            part, size = part + 1, 0
            return row

        for batch in batches:
            for key, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                raw = record_bytes("" if key is None else str(key), url, payload, digest, len(payload), refers)
                index.append(f"{size}\t{len(raw)}\n")
                data.append(raw)
                size += len(raw)
                if size >= ROLL:
                    yield close()
        if data:
            yield close()

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write all rows as WARC records into ZIP archives below ``folder``; the manifest (path, records, bytes)."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # equal payloads: narrow rows, summed before the shuffle; only groups with copies matter
    sha = F.sha2("payload", 256)
    groups = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy(sha.alias("sha"))
        .agg(F.max("key").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1 AND keeper IS NOT NULL")
        .select("sha", "keeper")
    )
    groups = stored(groups, "payloads")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    met = rows.withColumn("sha", F.when(F.octet_length("payload") >= least, sha)).join(groups, "sha", "left")
    refers = F.when(~F.col("key").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.col("keeper").cast("string"))
    return stored(met.select("key", "url", "payload", "digest", refers.alias("refers")).mapInArrow(_writer(folder), _MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, inner = _open(path)
            with system.open_input_file(inner) as source:
                reader = _At(source)
                members = read_members(reader, source.size())
                rows = []
                for data, offset, length in _places(reader, members):
                    fields, payload = parse_record(reader.read_at(length, data.start + offset))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    refers = fields.get("x-refers-to-page-id")
                    if refers is None and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['x-page-id']} in {path} is damaged")
                    size = len(payload) if refers is None else int(fields["x-payload-length"])
                    rows.append((fields["x-page-id"] or None, size, digest, fields["warc-type"], refers))
                    if len(rows) == 5_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)


def archive_pairs(names) -> list[tuple[str, str]]:
    """Every member below archive/ with its index below indexes/: of the same name up to the first dot, else the one left over."""
    stem = lambda name: name.rsplit("/", 1)[1].split(".")[0]
    found = sorted(n for n in names if n.startswith("archive/") and not n.endswith("/"))
    free = {stem(n): n for n in names if n.startswith("indexes/") and not n.endswith("/")}
    pairs = [(n, free.pop(stem(n))) for n in found if stem(n) in free]
    alone = sorted(set(found) - {n for n, _ in pairs})
    if len(alone) != len(free) or len(alone) > 1:
        raise ValueError(f"archives {alone} and indexes {sorted(free.values())} do not belong together")
    return pairs + list(zip(alone, free.values()))


def _places(reader, members: dict) -> Iterator[tuple]:
    """The archive member, offset and length of every record, by the members' own indexes."""
    for name, index in archive_pairs(members):
        place = members[index]
        for line in reader.read_at(place.size, place.start).decode().splitlines():
            yield members[name], *map(int, line.split("\t"))


class _At:
    """Range reads of an open file."""

    def __init__(self, source):
        self.source = source

    def read_at(self, length: int, offset: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives in ``manifest``."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = manifest.select("path").repartition(n)
    return paths.mapInArrow(_read, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archive_table(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives."""
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType
    folder = scratch_path(pages.sparkSession, "archives")
    read = read_archives(write_archives(rows, folder))
    return read.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
