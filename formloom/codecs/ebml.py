"""EBML elements, and tracks, blocks and cue points of WebM and Matroska."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from formloom.errors import require

#: Element ids.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, TRACKS, ENTRY, NUMBER, KIND, CODEC = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86
CLUSTER, TIMECODE, SIMPLE, GROUP, BLOCK, REFERENCE, CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, ENTRY, CLUSTER, GROUP, CUES, POINT, POSITIONS}
MAX_DEPTH, MAX_ELEMENTS = 16, 10_000_000


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length number and its length; -1 for a size whose bits are all ones (unknown)."""
    require(at < len(data) and data[at], "EBML_BAD_VINT", str(at))
    n = 9 - data[at].bit_length()
    require(at + n <= len(data), "EBML_TRUNCATED")
    v = int.from_bytes(data[at : at + n])
    if keep_marker:
        require(n <= 4, "EBML_BAD_ID")
        return v, n
    v &= (1 << 7 * n) - 1
    return (-1 if v == (1 << 7 * n) - 1 else v), n


def to_vint(v: int, n: int | None = None) -> bytes:
    n = n or next(k for k in range(1, 9) if v < (1 << 7 * k) - 1)
    return (v | 1 << 7 * n).to_bytes(n)


def elements(data: bytes, at: int = 0, end: int | None = None, depth: int = 0, masters: set[int] | frozenset[int] = frozenset(MASTERS)) -> Iterator[tuple[int, int, int, int, int]]:
    """id, depth, offset, payload offset and size, parents before their children."""
    end = len(data) if end is None else end
    require(depth <= MAX_DEPTH, "EBML_TOO_DEEP")
    while at < end:
        kind, a = vint(data, at, True)
        size, b = vint(data, at + a)
        body = at + a + b
        size = end - body if size < 0 else size
        require(body + size <= end, "EBML_TRUNCATED", hex(kind))
        yield kind, depth, at, body, size
        if kind in masters:
            yield from elements(data, body, body + size, depth + 1, masters)
        at = body + size


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8) + to_vint(len(body)) + body


def number(kind: int, v: int) -> bytes:
    return element(kind, v.to_bytes(max(1, (v.bit_length() + 7) // 8)))


def _laced(body: bytes, flags: int) -> list[bytes]:
    """Frames of a block: none, Xiph, fixed or EBML lacing."""
    kind = flags >> 1 & 3
    if not kind:
        return [body]
    require(body, "BLOCK_TRUNCATED")
    n, at, sizes = body[0] + 1, 1, []
    if kind == 2:
        require((len(body) - 1) % n == 0, "BLOCK_LACING")
        each = (len(body) - 1) // n
        return [body[1 + i * each : 1 + (i + 1) * each] for i in range(n)]
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while True:
                require(at < len(body), "BLOCK_LACING")
                size, at, more = size + body[at], at + 1, body[at] == 255
                if not more:
                    break
        else:
            v, k = vint(body, at)
            size = v if not i else sizes[-1] + v - ((1 << 7 * k - 1) - 1)
            at += k
        require(size >= 0, "BLOCK_LACING")
        sizes.append(size)
    require(at + sum(sizes) <= len(body), "BLOCK_LACING")
    out = []
    for s in [*sizes, len(body) - at - sum(sizes)]:
        out.append(body[at : at + s])
        at += s
    return out


def doc_type(data: bytes) -> str:
    for kind, _, _, body, size in elements(data, masters=frozenset({EBML})):
        if kind == DOCTYPE:
            return data[body : body + size].rstrip(b"\0").decode()
    return "matroska"


def tracks(data: bytes) -> Iterator[tuple[int, str, str]]:
    """number, kind and codec of each track."""
    now: dict = {}
    for kind, _, _, body, size in elements(data):
        if kind == ENTRY and now:
            yield now["n"], now["k"], now["c"]
        if kind == ENTRY:
            now = {"n": 0, "k": "other", "c": ""}
        elif now and kind == NUMBER:
            now["n"] = int.from_bytes(data[body : body + size])
        elif now and kind == KIND:
            now["k"] = {1: "video", 2: "audio", 17: "subtitle"}.get(data[body + size - 1], "other")
        elif now and kind == CODEC:
            now["c"] = data[body : body + size].decode()
    if now:
        yield now["n"], now["k"], now["c"]


def frames(data: bytes) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """ordinal, track, timestamp_us (truncated), keyframe and payload of each laced frame."""
    require(data[:4] == b"\x1a\x45\xdf\xa3", "EBML_BAD_MAGIC")
    scale, cluster, n, waiting = 1_000_000, 0, 0, None
    for kind, _, _, body, size in elements(data):
        raw = data[body : body + size]
        if kind == SCALE:
            scale = int.from_bytes(raw)
        elif kind == TIMECODE:
            cluster = int.from_bytes(raw)
        elif kind == GROUP:
            waiting = not any(k == REFERENCE for k, d, *_ in elements(data, body, body + size) if not d)
        elif kind in (SIMPLE, BLOCK):
            track, k = vint(raw, 0)
            require(len(raw) >= k + 3, "BLOCK_TRUNCATED")
            (rel,) = struct.unpack_from(">h", raw, k)
            flags = raw[k + 2]
            key = bool(flags & 0x80) if kind == SIMPLE else bool(waiting)
            for part in _laced(raw[k + 3 :], flags):
                n += 1
                yield n, track, (cluster + rel) * scale // 1000, key, part


def cue_points(data: bytes) -> Iterator[tuple[int, int, int]]:
    """time, track and cluster position."""
    time = track = 0
    for kind, _, _, body, size in elements(data):
        v = int.from_bytes(data[body : body + size]) if size <= 8 else 0
        if kind == CUE_TIME:
            time = v
        elif kind == CUE_TRACK:
            track = v
        elif kind == CUE_CLUSTER:
            yield time, track, v


def build(blocks: list[tuple[int, int, bool, bytes]], listed: list[tuple[int, str, str]], doc: str = "matroska", scale: int = 1_000_000) -> bytes:
    """blocks: track, time in ticks, keyframe, payload; a new cluster where a block's time leaves 16 bits."""
    head = element(EBML, element(DOCTYPE, doc.encode()))
    kinds = {"video": 1, "audio": 2, "subtitle": 17}
    entries = b"".join(element(ENTRY, number(NUMBER, n) + number(KIND, kinds[k]) + element(CODEC, c.encode())) for n, k, c in listed)
    body, cluster, start, cues = element(INFO, number(SCALE, scale)) + element(TRACKS, entries), b"", None, b""
    for track, t, key, payload in blocks:
        if start is None or not -32_768 <= t - start < 32_768:
            body += element(CLUSTER, cluster) if start is not None else b""
            cues += element(POINT, number(CUE_TIME, t) + element(POSITIONS, number(CUE_TRACK, track) + number(CUE_CLUSTER, len(body))))
            cluster, start = number(TIMECODE, t), t
        cluster += element(SIMPLE, to_vint(track) + struct.pack(">hB", t - start, 0x80 if key else 0) + payload)
    body += element(CLUSTER, cluster) if start is not None else b""
    return head + element(SEGMENT, body + element(CUES, cues))
