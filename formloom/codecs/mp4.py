"""MP4: boxes, tracks, sample tables and fragments."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from formloom.errors import require

CONTAINERS = {"moov", "trak", "mdia", "minf", "stbl", "edts", "mvex", "moof", "traf", "udta", "dinf"}
MAX_DEPTH = 10

Box = tuple[str, int, int, int, int]


def boxes(data: bytes, at: int = 0, end: int | None = None, depth: int = 0, path: str = "") -> Iterator[tuple[str, str, int, int, int, int]]:
    """path, type, depth, offset, payload offset and payload size; parents first."""
    end = len(data) if end is None else end
    require(depth <= MAX_DEPTH, "MP4_TOO_DEEP")
    while at < end:
        require(at + 8 <= end, "MP4_TRUNCATED")
        size, kind, head = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16]), 16
        size = end - at if size == 0 else size
        require(size >= head and at + size <= end, "MP4_BOX_SIZE", kind)
        own = f"{path}/{kind}"
        yield own, kind, depth, at, at + head, size - head
        if kind in CONTAINERS:
            yield from boxes(data, at + head, at + size, depth + 1, own)
        at += size


def _table(body: bytes, n: int, row: str) -> list[tuple]:
    size = struct.calcsize(row)
    require(8 + n * size <= len(body), "MP4_TABLE_TRUNCATED")
    return list(struct.iter_unpack(row, body[8 : 8 + n * size]))


def tracks(data: bytes) -> list[dict]:
    """One dictionary per track: id, kind, codec, timescale and its run-length tables."""
    require(data[4:8] == b"ftyp", "MP4_NO_FTYP")
    out: list[dict] = []
    for _, kind, _, _, at, size in boxes(data):
        b = data[at : at + size]
        if kind == "trak":
            out.append({"id": 0, "kind": "other", "codec": "", "timescale": 1, "stts": [], "stsc": [], "stsz": [], "stco": [], "stss": None, "elst": []})
        if not out:
            continue
        t = out[-1]
        n = int.from_bytes(b[4:8])
        if kind == "tkhd":
            t["id"] = int.from_bytes(b[20:24] if b[0] else b[12:16])
        elif kind == "mdhd":
            t["timescale"] = int.from_bytes(b[20:24] if b[0] else b[12:16])
            require(t["timescale"], "MP4_TIMESCALE")
        elif kind == "hdlr":
            t["kind"] = {b"vide": "video", b"soun": "audio"}.get(b[8:12], "other")
        elif kind == "stsd":
            t["codec"] = b[12:16].decode("latin-1")
        elif kind in ("stts", "stsc", "stco", "co64", "stss"):
            rows = _table(b, n, {"stts": ">II", "stsc": ">III", "stco": ">I", "co64": ">Q", "stss": ">I"}[kind])
            t["stco" if kind == "co64" else kind] = rows if kind in ("stts", "stsc") else [r[0] for r in rows]
        elif kind == "stsz":
            same, n = struct.unpack_from(">II", b, 4)
            t["stsz"] = [same] * n if same else [x for (x,) in struct.iter_unpack(">I", b[12 : 12 + 4 * n])]
            require(len(t["stsz"]) == n, "MP4_TABLE_TRUNCATED")
        elif kind == "elst":
            t["elst"] = [(d, m) for d, m, _ in struct.iter_unpack(">QqI" if b[0] else ">IiI", b[8 : 8 + n * (20 if b[0] else 12)])]
    require(out, "MP4_NO_TRACKS")
    return out


def tables(data: bytes) -> Iterator[tuple[int, str, str, int, str, int, int, int, int]]:
    """Run-length tables as rows: track, kind, codec, timescale, table, ordinal and three values. Windows do the rest."""
    for t in tracks(data):
        own = t["id"], t["kind"], t["codec"], t["timescale"]
        for name in ("stts", "stsc", "stsz", "stco", "stss", "elst"):
            for i, r in enumerate(t[name] or []):
                v = [*(r if isinstance(r, tuple) else (r,)), 0, 0][:3]
                yield (*own, name, i + 1, *v)


def fragments(data: bytes) -> Iterator[tuple[int, int, int, int, int | None, int | None, int | None, int | None]]:
    """track, fragment, run, ordinal and the run's own duration, size, flags and the fragment's base time; missing values stay null for the defaults."""
    frag = run = track = 0
    base = None
    for _, kind, _, _, at, size in boxes(data):
        b = data[at : at + size]
        if kind == "moof":
            frag, run = frag + 1, 0
        elif kind == "tfhd":
            track, base = int.from_bytes(b[4:8]), None
        elif kind == "tfdt":
            base = int.from_bytes(b[4:12] if b[0] else b[4:8])
        elif kind == "trun":
            flags, n = int.from_bytes(b[1:4]), int.from_bytes(b[4:8])
            p, run = 8 + (4 if flags & 1 else 0) + (4 if flags & 4 else 0), run + 1
            for i in range(n):
                got = {}
                for bit in (0x100, 0x200, 0x400, 0x800):
                    if flags & bit:
                        require(p + 4 <= len(b), "MP4_TRUN_TRUNCATED")
                        got[bit], p = int.from_bytes(b[p : p + 4]), p + 4
                yield track, frag, run, i + 1, got.get(0x100), got.get(0x200), got.get(0x400), base


def fragment_defaults(data: bytes) -> Iterator[tuple[str, int, int, int | None, int | None, int | None]]:
    """level (traf or trex), track, fragment (0 for trex) and default duration, size and flags."""
    frag = 0
    for _, kind, _, _, at, size in boxes(data):
        b = data[at : at + size]
        if kind == "moof":
            frag += 1
        elif kind == "trex":
            v = struct.unpack(">IIIII", b[4:24])
            yield "trex", v[0], 0, v[2], v[3], v[4]
        elif kind == "tfhd":
            flags, p, got = int.from_bytes(b[1:4]), 8, {}
            for bit, n in ((1, 8), (2, 4), (8, 4), (0x10, 4), (0x20, 4)):
                if flags & bit:
                    got[bit], p = int.from_bytes(b[p : p + n]), p + n
            yield "traf", int.from_bytes(b[4:8]), frag, got.get(8), got.get(0x10), got.get(0x20)


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4) + kind.encode("latin-1") + body


def build(listed: list[dict]) -> bytes:
    """Tracks with payloads (samples: list of bytes, delta per sample, sync numbers or None); one sample to a chunk."""
    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    rows = lambda row, items: len(items).to_bytes(4) + b"".join(struct.pack(row, *i) for i in items)
    head = box("ftyp", b"isom", bytes(4), b"isommp42")
    at, body, traks = len(head) + 8, b"", b""
    for t in listed:
        offsets = []
        for s in t["samples"]:
            offsets.append((at + len(body),))
            body += s
        runs: list[list[int]] = []
        for d in t["deltas"]:
            if runs and runs[-1][1] == d:
                runs[-1][0] += 1
            else:
                runs.append([1, d])
        stbl = box("stbl", full("stsd", (1).to_bytes(4), box(t.get("codec", "mp4a"), bytes(28))), full("stts", rows(">II", runs)), full("stsc", rows(">III", [(1, 1, 1)])),
                   full("stsz", bytes(4), rows(">I", [(len(s),) for s in t["samples"]])), full("stco", rows(">I", offsets)), *([full("stss", rows(">I", [(x,) for x in t["sync"]]))] if t.get("sync") is not None else []))
        kind = {"video": b"vide", "audio": b"soun"}[t["kind"]]
        elst = box("edts", full("elst", rows(">IiI", [(d, m, 0x10000) for d, m in t["edits"]]))) if t.get("edits") else b""
        mdia = box("mdia", full("mdhd", bytes(8), t["timescale"].to_bytes(4), bytes(8)), full("hdlr", bytes(4), kind, bytes(13)), box("minf", stbl))
        traks += box("trak", full("tkhd", bytes(8), t["id"].to_bytes(4), bytes(68)), elst, mdia)
    return head + box("mdat", body) + box("moov", full("mvhd", bytes(96)), traks)


def build_fragmented(track: int, timescale: int, default: int, runs: list[list[tuple[int | None, bytes]]]) -> bytes:
    """Fragments with one run each; a duration of None leaves the sample to the default."""
    full = lambda kind, flags, *parts: box(kind, flags.to_bytes(4), *parts)
    mdia = box("mdia", full("mdhd", 0, bytes(8), timescale.to_bytes(4), bytes(8)), full("hdlr", 0, bytes(4), b"soun", bytes(13)), box("minf", box("stbl")))
    moov = box("moov", box("trak", full("tkhd", 0, bytes(8), track.to_bytes(4), bytes(68)), mdia), box("mvex", full("trex", 0, struct.pack(">IIIII", track, 1, default, 0, 0))))
    out, base = box("ftyp", b"isom", bytes(4)) + moov, 0
    for run in runs:
        own = all(d is not None for d, _ in run)
        body = b"".join((d.to_bytes(4) if own else b"") + len(p).to_bytes(4) for d, p in run)
        trun = full("trun", 0x200 | (0x100 if own else 0), len(run).to_bytes(4), body)
        out += box("moof", box("traf", full("tfhd", 0x20000, track.to_bytes(4)), full("tfdt", 0x1000000, base.to_bytes(8)), trun)) + box("mdat", *[p for _, p in run])
        base += sum(default if d is None else d for d, _ in run)
    return out
