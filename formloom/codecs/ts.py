"""MPEG transport streams: packets, section tables, packetised streams, and byte forms of H.264."""

from __future__ import annotations

import re
from collections.abc import Iterator

from formloom.codecs.checksums import crc32_psi
from formloom.errors import require

PACKET = 188
#: Stream types.
H264, AAC = 0x1B, 0x0F


def packets(data: bytes) -> Iterator[tuple[int, int, bool, int, bytes]]:
    """ordinal, pid, payload_unit_start, continuity counter and payload; lost sync is found again where two packets follow."""
    at, n = 0, 0
    while at + PACKET <= len(data):
        if data[at] != 0x47:
            at += 1
            while at + PACKET <= len(data) and not (data[at] == 0x47 and (at + PACKET == len(data) or data[at + PACKET : at + PACKET + 1] == b"G")):
                at += 1
            continue
        p = data[at : at + PACKET]
        at += PACKET
        require(not p[3] & 0xC0, "TS_SCRAMBLED")
        if p[1] & 0x80:
            continue
        n += 1
        start = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        yield n, (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] & 15, p[start:] if p[3] & 0x10 else b""
    require(n, "TS_NO_PACKETS")


def section(held: bytes) -> bytes | None:
    """A whole section after its pointer field, checked; None while it is incomplete."""
    if not held or len(held) < 4 + held[0]:
        return None
    body = held[1 + held[0] :]
    size = 3 + ((body[1] & 15) << 8 | body[2])
    if len(body) < size:
        return None
    require(not crc32_psi(body[:size]), "TS_PSI_CRC")
    return body[: size - 4]


def streams(data: bytes) -> dict[int, int]:
    """pid -> stream type, from the one program's map."""
    held: dict[int, bytes] = {}
    pmt, out = None, None
    for _, pid, start, _, payload in packets(data):
        if pid not in (0, pmt):
            continue
        held[pid] = payload if start else held.get(pid, b"") + payload
        s = section(held[pid])
        if s is None:
            continue
        if pid == 0:
            listed = [((s[i] << 8 | s[i + 1]), (s[i + 2] & 31) << 8 | s[i + 3]) for i in range(8, len(s) - 3, 4)]
            found = [p for number, p in listed if number]
            require(len(found) == 1, "TS_MULTI_PROGRAM" if found else "TS_NO_PROGRAM")
            pmt = found[0]
        elif out is None:
            at, out = 12 + ((s[10] & 15) << 8 | s[11]), {}
            while at + 5 <= len(s):
                out[(s[at + 1] & 31) << 8 | s[at + 2]] = s[at]
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
    require(out, "TS_NO_PMT")
    return out


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def pes(data: bytes) -> Iterator[tuple[int, int, int, int | None, int | None, bytes]]:
    """pid, stream type, ordinal, pts, dts and payload of each packetised unit, in the order in which they end."""
    kinds = streams(data)
    held: dict[int, bytes] = {}
    count: dict[int, int] = {}

    def done(pid: int):
        raw = held.pop(pid)
        require(raw[:3] == b"\0\0\1" and len(raw) >= 9, "TS_BAD_PES")
        flags, head = raw[7] >> 6, 9 + raw[8]
        pts = _stamp(raw[9:14]) if flags & 2 else None
        dts = _stamp(raw[14:19]) if flags == 3 else pts
        size = int.from_bytes(raw[4:6])
        count[pid] = count.get(pid, 0) + 1
        return pid, kinds[pid], count[pid], pts, dts, raw[head : 6 + size if size else len(raw)]

    for _, pid, start, _, payload in packets(data):
        if pid not in kinds:
            continue
        if start:
            if pid in held:
                yield done(pid)
            held[pid] = payload
        elif pid in held:
            held[pid] += payload
    for pid in sorted(held):
        yield done(pid)


def _packet(pid: int, start: bool, cc: int, payload: bytes) -> bytes:
    """One packet; what is missing is filled up by an adaptation field."""
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255])
    room = 184 - len(payload)
    if not room:
        return head + bytes([0x10 | cc]) + payload
    field = bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"")
    return head + bytes([0x30 | cc]) + field + payload


def _section(kind: int, body: bytes) -> bytes:
    s = bytes([kind, 0xB0 | len(body) + 4 >> 8, len(body) + 4 & 255]) + body
    return b"\0" + s + crc32_psi(s).to_bytes(4)


def build(units: list[tuple[int, int, bytes]], kinds: dict[int, int], program: int = 0x1000) -> bytes:
    """units: pid, pts, payload; with one program's tables before them."""
    pat = _section(0, b"\0\1\xc1\0\0" + b"\0\1" + (0xE000 | program).to_bytes(2))
    first = next(iter(kinds))
    pmt = _section(2, b"\0\1\xc1\0\0" + (0xE000 | first).to_bytes(2) + b"\xf0\0" + b"".join(bytes([k]) + (0xE000 | p).to_bytes(2) + b"\xf0\0" for p, k in kinds.items()))
    out, cc = bytearray(), {0: 0, program: 0}

    def put(pid: int, raw: bytes) -> None:
        for i in range(0, len(raw), 184):
            c = cc.get(pid, 0)
            out.extend(_packet(pid, i == 0, c, raw[i : i + 184]))
            cc[pid] = (c + 1) % 16

    put(0, pat)
    put(program, pmt)
    for pid, t, payload in units:
        stamp = bytes([0x21 | t >> 29 & 14, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])
        size = len(payload) + 8
        put(pid, b"\0\0\1" + bytes([0xE0 if kinds[pid] == H264 else 0xC0]) + (size if size < 65_536 else 0).to_bytes(2) + b"\x80\x80\x05" + stamp + payload)
    return bytes(out)


def annexb_units(data: bytes) -> list[bytes]:
    """Units between start codes."""
    parts = re.split(rb"\x00\x00\x01", data)
    return [p.rstrip(b"\0") for p in parts[1:] if p.rstrip(b"\0")]


def to_avcc(data: bytes) -> bytes:
    return b"".join(len(u).to_bytes(4) + u for u in annexb_units(data))


def to_annexb(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4])
        require(at + 4 + n <= len(data), "AVCC_TRUNCATED")
        out += b"\0\0\0\1" + data[at + 4 : at + 4 + n]
        at += 4 + n
    return bytes(out)


def without_emulation(unit: bytes) -> bytes:
    return re.sub(rb"\x00\x00\x03", b"\0\0", unit)


def avc_codec_string(sps: bytes) -> str:
    return "avc1." + sps[1:4].hex().upper()
