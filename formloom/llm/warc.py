r"""WARC records in ZIP-packaged archives, read by range without extraction.

Writing: each task packs its records into archives of bounded size. A record is a gzip member
of its own, so that it can be read alone; the records form the stored ZIP member
``archive/data.warc.gz``, and the stored member ``indexes/index.cdxj`` has a line of JSON per
record with its offset and length. All sizes and offsets are written as ZIP64. File names hold
the task's attempt, and only the names that Spark commits to the manifest are ever read, so a
lost or repeated task leaves no trace in the result.

Reading: the end record, the ZIP64 locator and end record and the central directory are parsed
from the archive's tail; the stored members are located through their local headers; then
each record named by the index is read by its range. Archives need no extraction and are
read in parallel.

Of records with equal payloads (of ``least`` bytes or more), that with the largest page_id is
the response and the others are revisits that refer to it, with headers but no payload.

Defined results: null html is an empty payload, and empty payloads are equal to one another;
rows that repeat the largest page_id are all responses; null page_ids come before any other,
so they are responses only if their group has no other id, and refers_to is then null; an
empty table gives no archives and an empty result. Files are reached through pyarrow's file
systems by the URI of the shared folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import fresh_path, small_batches, written

#: Compressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 32 << 20
LEVEL = 4
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: ZIP signatures, and the date given to every record and member.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
DATE, DOS_DATE = "2024-01-01T00:00:00Z", (44 << 9) | (1 << 5) | 1
U16, U32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _uri(url: str | None) -> str:
    """A header-safe form of a URL: control characters and spaces are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record; a revisit's block is the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}",
            f"WARC-Payload-Digest: sha1:{sha}", *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page(refers_to)}"] if revisit else []),
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def pack(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP archive of stored members with ZIP64 sizes and offsets throughout."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, DOS_DATE, crc, U32, U32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
        central += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, DOS_DATE, crc, U32, U32, len(raw), 28, 0, 0, 0, 0, U32) + raw + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
    at, end = len(out), len(out) + len(central)
    out += central
    out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(central), at)
    out += LOCATOR + struct.pack("<IQI", 0, end, 1)
    out += END + struct.pack("<HHHHIIH", 0, 0, U16, U16, U32, U32, 0)
    return bytes(out)


class ZipReader:
    """Directory of a ZIP archive in a seekable file, and ranges of its stored members."""

    def __init__(self, f, size: int):
        self.f = f
        tail_at = max(0, size - (22 + U16))
        tail = self._read(tail_at, size - tail_at)
        end = tail.rfind(END)
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(END, 0, end)  # a signature inside the comment
        if end < 0:
            raise ValueError("no ZIP end record")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if U16 == count or U32 in (length, at):
            where = tail_at + end - 20
            locator = self._read(where, 20) if where >= 0 else b""
            if locator[:4] != LOCATOR:
                raise ValueError("no ZIP64 locator")
            end64 = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end record")
            count, length, at = struct.unpack_from("<QQQ", end64, 32)
        self.members = dict(self._directory(self._read(at, length), count))
        self._starts: dict[str, tuple[int, int]] = {}

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        got = self.f.read(n)
        if len(got) != n:
            raise ValueError("archive is cut off")
        return got

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """Name and (method, stored size, place of the local header) of each member."""
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("bad central directory")
            method, _, _, _, stored, size, n, extra_n, comment_n = struct.unpack_from("<HHHIIIHHH", raw, at + 10)
            (place,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n].decode()
            e, stop = at + 46 + n, at + 46 + n + extra_n
            while e + 4 <= stop:
                kind, length = struct.unpack_from("<HH", raw, e)
                if kind == 1:  # ZIP64: only the fields that are full elsewhere, in this order
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", raw, e + 4))
                    size = next(wide) if size == U32 else size
                    stored = next(wide) if stored == U32 else stored
                    place = next(wide) if place == U32 else place
                e += 4 + length
            yield name, (method, stored, place)
            at = stop + comment_n

    def start(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are; its local header is read once."""
        if name in self._starts:
            return self._starts[name]
        method, stored, place = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed, so it has no ranges")
        head = self._read(place, 30)
        if head[:4] != LOCAL:
            raise ValueError("bad local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        self._starts[name] = place + 30 + n + extra, stored
        return self._starts[name]

    def range(self, name: str, offset: int, length: int) -> bytes:
        at, stored = self.start(name)
        if offset < 0 or length < 0 or offset + length > stored:
            raise ValueError("range outside the member")
        return self._read(at + offset, length)


def _files(path: str):
    """File system and path of a URI or a local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, sha (SHA-256, for equality) and refers_to, the group's largest page_id (null for a lone or short payload)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.sha2("payload", 256))
    # Only digests are grouped; payloads meet their group's figures once, in a join that AQE can split.
    groups = p.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return p.join(groups.withColumn("many", F.lit(True)), "sha", "left").withColumn("many", F.coalesce("many", F.lit(False)))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row and return the manifest (path, records) of the archives."""
    small_batches(pages.sparkSession)
    folder = folder or fresh_path(pages.sparkSession, "warc")

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        files, root = _files(folder)
        task = TaskContext.get()
        data, index, done = bytearray(), [], 0

        def close() -> pd.DataFrame:
            nonlocal done
            name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{done:04d}.zip"
            files.create_dir(root, recursive=True)
            with files.open_output_stream(name) as out:
                out.write(pack([(DATA, bytes(data)), (INDEX, "".join(sorted(index)).encode())]))
            out = pd.DataFrame({"path": [f"{folder}/{name.rpartition('/')[2]}"], "records": [len(index)]})
            done += 1
            data.clear()
            index.clear()
            return out

        for f in frames:
            for page_id, url, payload, refers_to, many in zip(f["page_id"], f["url"], f["payload"], f["refers_to"], f["many"], strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                url, payload, sha = None if pd.isna(url) else url, bytes(payload), digest(payload)
                raw = gzip.compress(record(page_id, url, payload, sha, refers_to, many and page_id != refers_to), LEVEL, mtime=0)
                index.append(f"{_uri(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps({'digest': sha, 'offset': len(data), 'length': len(raw), 'page': page_id})}\n")
                data += raw
                if len(data) >= archive_bytes:
                    yield close()
        if index:
            yield close()

    return written(typed(pages, least).select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"), "many").mapInPandas(put, "path string, records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and html (null for revisits) of every record."""
    small_batches(manifest.sparkSession)

    def get(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page = lambda s: None if s is None or s == _page(None) else int(s[10:-1])
        for path in (p for f in frames for p in f["path"]):
            files, local = _files(path)
            rows = []
            with files.open_input_file(local) as f:
                z = ZipReader(f, f.size())
                for line in z.range(INDEX, 0, z.start(INDEX)[1]).decode().split("\n")[:-1]:
                    entry = json.loads(line.split(" ", 2)[2])
                    head, http, payload = parse_record(gzip.decompress(z.range(DATA, entry["offset"], entry["length"])))
                    kind, sha = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != sha:
                        raise ValueError(f"{path}: payload of {head['WARC-Record-ID']} does not match its digest")
                    size = len(payload) if kind == "response" else int(http["Content-Length"])
                    rows.append((page(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, sha, kind, page(head.get("WARC-Refers-To")), payload.decode() if kind == "response" else None))
                    if len(rows) >= 500:
                        yield _frame(rows)
                        rows = []
            if rows:
                yield _frame(rows)

    # Archives are units of work of bounded size.
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInPandas(get, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"], dtype=object)
    return f.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})
