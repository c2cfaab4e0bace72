"""Ogg pages and packets, and the headers of Opus and Vorbis."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from formloom.codecs.checksums import crc32_ogg
from formloom.errors import require


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, int, list[int], bytes]]:
    """offset, flags, granule, serial, sequence, lacing values and payload; checksums must hold."""
    at = 0
    while at < len(data):
        require(data[at : at + 4] == b"OggS" and at + 27 <= len(data), "OGG_LOST_SYNC", str(at))
        version, flags, granule, serial, seq, crc, n = struct.unpack_from("<BBqIIIB", data, at + 4)
        require(version == 0, "OGG_VERSION")
        lacing = list(data[at + 27 : at + 27 + n])
        end = at + 27 + n + sum(lacing)
        require(len(lacing) == n and end <= len(data), "OGG_TRUNCATED")
        require(crc32_ogg(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc, "OGG_CRC")
        yield at, flags, granule, serial, seq, lacing, data[at + 27 + n : end]
        at = end


def codec_of(packet: bytes) -> tuple[str, int, int] | None:
    """codec, channels and sample rate of a first packet; Opus always runs at 48,000."""
    if packet[:8] == b"OpusHead" and len(packet) >= 19:
        return "opus", packet[9], 48_000
    if packet[:7] == b"\x01vorbis" and len(packet) >= 30:
        return "vorbis", packet[11], int.from_bytes(packet[12:16], "little")
    return None


def packets(data: bytes) -> Iterator[tuple[int, int, str, int, int, int, int, bytes]]:
    """stream, serial, codec, channels, sample_rate, ordinal, granule and packet; streams follow each other in a chain."""
    state, done, stream, last = None, 0, -1, {}
    for _, flags, granule, serial, seq, lacing, payload in pages(data):
        if flags & 2:
            require(state is None or state["ended"] or not state["open"], "OGG_MULTIPLEXED")
            stream += 1
            state = {"serial": serial, "held": b"", "n": 0, "ended": False, "codec": None, "open": True}
            last[serial] = -1
        if state is None or serial != state["serial"]:
            require(serial in last or state is not None, "OGG_NO_STREAM")
            continue
        require(seq == last[serial] + 1, "OGG_SEQUENCE_GAP", str(seq))
        last[serial] = seq
        require(bool(flags & 1) == bool(state["held"]) or not state["held"], "OGG_CONTINUATION")
        at, ends = 0, [i for i, v in enumerate(lacing) if v < 255]
        for i, v in enumerate(lacing):
            state["held"] += payload[at : at + v]
            at += v
            if v == 255:
                continue
            packet, state["held"] = state["held"], b""
            if state["codec"] is None:
                state["codec"] = codec_of(packet)
                require(state["codec"], "OGG_CODEC")
            state["n"] += 1
            done += 1
            yield stream, serial, *state["codec"], state["n"], granule if i == ends[-1] else -1, packet
        state["ended"] = bool(flags & 4)
        state["open"] = not state["ended"]
    require(done, "OGG_EMPTY")


def build(items: list[bytes], serial: int = 1, granules: list[int] | None = None) -> bytes:
    """One packet to a page, or several pages where it is long; the first page begins the stream, the last ends it."""
    out, seq = bytearray(), 0
    for i, p in enumerate(items):
        lacing = [255] * (len(p) // 255) + [len(p) % 255]
        parts = [lacing[k : k + 255] for k in range(0, len(lacing), 255)]
        at = 0
        for j, part in enumerate(parts):
            flags = (1 if j else 0) | (2 if not seq else 0) | (4 if i == len(items) - 1 and j == len(parts) - 1 else 0)
            granule = (granules[i] if granules else i) if j == len(parts) - 1 else -1
            body = p[at : at + sum(part)]
            at += sum(part)
            page = bytearray(b"OggS" + struct.pack("<BBqIIIB", 0, flags, granule, serial, seq, 0, len(part)) + bytes(part) + body)
            page[22:26] = struct.pack("<I", crc32_ogg(bytes(page)))
            out += page
            seq += 1
    return bytes(out)


def opus_head(channels: int = 2, rate: int = 48_000) -> bytes:
    return b"OpusHead" + struct.pack("<BBHIhB", 1, channels, 312, rate, 0, 0)
