"""ZIP, TAR and gzip with strict checks: names, sizes, ratios and checksums."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

from formloom.errors import FormatError, require

#: Caps.
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_RATIO = 65_535, 256 << 20, 512 << 20, 1_000
EPOCH = datetime(1980, 1, 1)

Entry = tuple[str, bool, int, str, int, datetime | None, bytes | None]


def safe_name(name: str) -> str:
    """The name with slashes, or an error: no NUL, no absolute or drive path, no way upwards."""
    n = name.replace("\\", "/")
    require(n, "ENTRY_NAME_EMPTY")
    require("\0" not in n, "ENTRY_NAME_NUL")
    require(not n.startswith("/"), "ENTRY_NAME_ABSOLUTE")
    require(not re.match("[A-Za-z]:", n), "ENTRY_NAME_DRIVE")
    require(".." not in n.split("/"), "ENTRY_NAME_TRAVERSAL")
    return n


def dos_time(date: int, time: int) -> datetime | None:
    try:
        return datetime((date >> 9) + 1980, date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, min(59, (time & 31) * 2))
    except ValueError:
        return None


def to_dos(t: datetime) -> tuple[int, int]:
    return (max(0, t.year - 1980) << 9 | t.month << 5 | t.day, t.hour << 11 | t.minute << 5 | t.second // 2)


def inflate(data: bytes, limit: int, wbits: int = -15) -> bytes:
    """Inflated data of limit bytes at most, without ever holding more."""
    return _inflated(data, limit, wbits)[0]


def _inflated(data: bytes, limit: int, wbits: int) -> tuple[bytes, bytes]:
    """Inflated data, and what follows the stream's end."""
    d = zlib.decompressobj(wbits)
    try:
        out = d.decompress(data, limit + 1)
    except zlib.error as e:
        raise FormatError("DEFLATE_ERROR", str(e)) from None
    require(len(out) <= limit, "SIZE_CAP")
    require(d.eof, "DEFLATE_TRUNCATED")
    return out, d.unused_data


def zip_entries(data: bytes, with_data: bool = True) -> Iterator[Entry]:
    """name, is_directory, size, method, crc32, modified, data; checksums are verified when data is wanted."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    require(end >= 0, "ZIP_NO_EOCD")
    disk, cd_disk, here, count, length, at, _ = struct.unpack_from("<HHHHIIH", data, end + 4)
    require(disk == cd_disk == 0 and here == count, "ZIP_MULTI_DISK")
    require(0xFFFF != count and 0xFFFFFFFF not in (length, at), "ZIP64_NOT_SUPPORTED")
    require(count <= MAX_ENTRIES and at + length <= end, "ZIP_BAD_DIRECTORY")
    total = 0
    for _ in range(count):
        require(data[at : at + 4] == b"PK\x01\x02", "ZIP_BAD_DIRECTORY")
        flags, method, time, date, crc, packed, size, n, extra, comment = struct.unpack_from("<HHHHIIIHHH", data, at + 8)
        (place,) = struct.unpack_from("<I", data, at + 42)
        name = safe_name(data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437"))
        at += 46 + n + extra + comment
        require(not flags & 1, "ZIP_ENCRYPTED", name)
        require(method in (0, 8), "ZIP_METHOD", str(method))
        total += size
        require(size <= MAX_ENTRY and total <= MAX_TOTAL, "ZIP_TOO_LARGE", name)
        require(size <= max(1, packed) * MAX_RATIO, "ZIP_BOMB", name)
        folder, body = name.endswith("/"), None
        if with_data and not folder:
            require(data[place : place + 4] == b"PK\x03\x04", "ZIP_BAD_LOCAL_HEADER", name)
            a, b = struct.unpack_from("<HH", data, place + 26)
            raw = data[place + 30 + a + b : place + 30 + a + b + packed]
            require(len(raw) == packed, "ZIP_TRUNCATED", name)
            body = inflate(raw, size) if method else raw
            require(len(body) == size and zlib.crc32(body) == crc, "ZIP_CRC_MISMATCH", name)
        yield name, folder, size, "deflate" if method else "stored", crc, dos_time(date, time), body


def build_zip(entries: list[tuple[str, bytes, datetime | None]], deflate: bool = True) -> bytes:
    out, central = bytearray(), bytearray()
    for name, body, modified in entries:
        raw, crc = safe_name(name).encode(), zlib.crc32(body)
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = c.compress(body) + c.flush() if deflate and body else body
        method = 8 if deflate and body else 0
        date, time = to_dos(modified or EPOCH)
        shared = struct.pack("<HHHHIIIHH", 0x800, method, time, date, crc, len(packed), len(body), len(raw), 0)
        central += b"PK\x01\x02" + struct.pack("<HH", 20, 20) + shared + struct.pack("<HHHII", 0, 0, 0, 0, len(out)) + raw
        out += b"PK\x03\x04" + struct.pack("<H", 20) + shared + raw + packed
    at = len(out)
    return bytes(out + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(central), at, 0))


def _octal(field: bytes) -> int:
    s = field.rstrip(b"\0 ").lstrip(b" ")
    require(re.fullmatch(rb"[0-7]*", s), "TAR_BAD_NUMBER")
    return int(s or b"0", 8)


def tar_entries(data: bytes) -> Iterator[Entry]:
    """POSIX ustar only; the first zero block ends the archive."""
    at, total, count = 0, 0, 0
    while at + 512 <= len(data):
        h = data[at : at + 512]
        if not any(h):
            return
        require(h[257:265] == b"ustar\x0000", "TAR_NOT_USTAR")
        require(sum(h[:148]) + sum(h[156:]) + 8 * 32 == _octal(h[148:156]), "TAR_CHECKSUM")
        kind, size = chr(h[156] or 48), _octal(h[124:136])
        require(kind in "05", "TAR_ENTRY_TYPE", kind)
        prefix, name = (h[a:b].split(b"\0")[0].decode() for a, b in ((345, 500), (0, 100)))
        name = safe_name(f"{prefix}/{name}" if prefix else name)
        total, count = total + size, count + 1
        require(size <= MAX_ENTRY and total <= MAX_TOTAL and count <= MAX_ENTRIES, "TAR_TOO_LARGE", name)
        body = data[at + 512 : at + 512 + size]
        require(len(body) == size, "TAR_TRUNCATED", name)
        folder = kind == "5"
        yield name, folder, size, "stored", zlib.crc32(body), datetime.fromtimestamp(_octal(h[136:148]), timezone.utc).replace(tzinfo=None), None if folder else body
        at += 512 + -(-size // 512) * 512
    require(at == len(data), "TAR_TRUNCATED")


def build_tar(entries: list[tuple[str, bytes, datetime | None]]) -> bytes:
    out = bytearray()
    for name, body, modified in entries:
        raw, prefix = safe_name(name).encode(), b""
        if len(raw) > 100:
            cut = raw.rfind(b"/", 0, 156)
            require(cut > 0 and len(raw) - cut - 1 <= 100, "TAR_NAME_TOO_LONG", name)
            prefix, raw = raw[:cut], raw[cut + 1 :]
        when = int((modified or EPOCH).replace(tzinfo=timezone.utc).timestamp())
        folder = name.endswith("/")
        h = bytearray(512)
        for at, v in ((0, raw), (100, b"0000755\0" if folder else b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % len(body)), (136, b"%011o\0" % when), (148, b" " * 8), (156, b"5" if folder else b"0"), (257, b"ustar\x0000"), (345, prefix)):
            h[at : at + len(v)] = v
        h[148:156] = b"%06o\0 " % sum(h)
        out += h + body + bytes(-len(body) % 512)
    return bytes(out) + bytes(1024)


def gunzip(data: bytes, limit: int = MAX_TOTAL) -> tuple[str | None, bytes]:
    """Name (if the header has one) and payload of a single-member gzip file. The magic may occur by chance within a stream, so members are told by what follows its end."""
    require(data[:3] == b"\x1f\x8b\x08", "GZIP_BAD_MAGIC")
    name = data[10 : data.index(b"\0", 10)].decode("latin-1") if data[3] & 8 and not data[3] & 4 else None
    body, rest = _inflated(data, limit, 31)
    require(b"\x1f\x8b\x08" not in rest, "GZIP_MULTI_MEMBER")
    return name, body


def gzip(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def archive_entries(data: bytes) -> Iterator[Entry]:
    """Any archive by its magic; gzip is opened when a TAR lies inside, and bzip2 and xz are refused."""
    require(not data.startswith(b"BZh"), "BZIP2_NOT_SUPPORTED")
    require(not data.startswith(b"\xfd7zXZ\0"), "XZ_NOT_SUPPORTED")
    if data.startswith(b"\x1f\x8b"):
        name, body = gunzip(data)
        if body[257:263] == b"ustar\0":
            yield from tar_entries(body)
        else:
            yield name or "data", False, len(body), "deflate", zlib.crc32(body), None, body
    elif data[257:263] == b"ustar\0":
        yield from tar_entries(data)
    else:
        yield from zip_entries(data)
