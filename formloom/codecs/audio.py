"""WAV, MP3, ADTS and FLAC: headers and frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from formloom.codecs.checksums import crc8, crc16
from formloom.errors import FormatError, require

#: Sample format tags of WAV.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def wav_chunks(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """id, offset and payload; chunks are padded to even sizes."""
    require(len(data) >= 12 and data[8:12] == b"WAVE", "WAV_NOT_WAVE")
    require(data[:4] != b"RF64", "WAV_RF64")
    require(data[:4] == b"RIFF", "WAV_NOT_RIFF")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "little")
        require(at + 8 + size <= len(data), "WAV_TRUNCATED", kind)
        yield kind, at, data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)


def parse_wav(data: bytes) -> tuple[int, int, int, str, int, bytes]:
    """sample_rate, channels, bits, format, n_frames, samples."""
    chunks = {}
    for kind, _, body in wav_chunks(data):
        chunks.setdefault(kind, body)
    require("fmt " in chunks and len(chunks["fmt "]) >= 16, "WAV_NO_FMT")
    require("data" in chunks, "WAV_NO_DATA")
    tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", chunks["fmt "])
    if tag == EXTENSIBLE:
        require(len(chunks["fmt "]) >= 26, "WAV_BAD_FMT")
        (tag,) = struct.unpack_from("<H", chunks["fmt "], 24)
    require(tag in (PCM, FLOAT) and bits in (8, 16, 24, 32) and channels and block == channels * bits // 8, "WAV_UNSUPPORTED")
    return rate, channels, bits, "float" if tag == FLOAT else "pcm", len(chunks["data"]) // block, chunks["data"]


def wav_extras(data: bytes) -> list[tuple[str, bytes]]:
    """The chunks besides the format and the samples, in order."""
    return [(kind, body) for kind, _, body in wav_chunks(data) if kind not in ("fmt ", "data")]


def build_wav(samples: bytes, rate: int, channels: int, bits: int, floating: bool = False, extras: list[tuple[str, bytes]] | None = None) -> bytes:
    """extras (id, payload) stand between the format and the samples."""
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", FLOAT if floating else PCM, channels, rate, rate * block, block, bits)
    chunk = lambda kind, payload: kind.encode("latin-1") + struct.pack("<I", len(payload)) + payload + bytes(len(payload) & 1)
    body = b"".join(chunk(*c) for c in [("fmt ", fmt), *(extras or []), ("data", samples)])
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


#: Kbps by (version 1, layer), and for lower versions; sample rates; samples per frame.
_V1 = {1: "32 64 96 128 160 192 224 256 288 320 352 384 416 448", 2: "32 48 56 64 80 96 112 128 160 192 224 256 320 384", 3: "32 40 48 56 64 80 96 112 128 160 192 224 256 320"}
_V2 = {1: "32 48 56 64 80 96 112 128 144 160 176 192 224 256", 2: "8 16 24 32 40 48 56 64 80 96 112 128 144 160"}
KBPS = {(1, k): [0, *map(int, v.split())] for k, v in _V1.items()} | {(v, k): [0, *map(int, _V2[min(k, 2)].split())] for v in (2, 25) for k in (1, 2, 3)}
MP3_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}


def mp3_header(h: bytes) -> tuple[int, int, int, int, int, int]:
    """version (1, 2 or 25), layer, kbps, sample_rate, frame size, samples."""
    version, layer = {3: 1, 2: 2, 0: 25}.get(h[1] >> 3 & 3), {3: 1, 2: 2, 1: 3}.get(h[1] >> 1 & 3)
    rate_i, bit_i = h[2] >> 2 & 3, h[2] >> 4
    require(version and layer and rate_i < 3 and 0 < bit_i < 15, "MP3_INVALID_FRAME")
    require(layer == 3, "MP3_LAYER")
    rate, kbps = MP3_RATES[version][rate_i], KBPS[version, layer][bit_i]
    return version, layer, kbps, rate, (144 if version == 1 else 72) * kbps * 1000 // rate + (h[2] >> 1 & 1), 1152 if version == 1 else 576


def mp3_frames(data: bytes) -> Iterator[tuple[int, int, int, int, int, int, int, bytes]]:
    """ordinal, offset, version, kbps, sample_rate, size, samples, payload; tags and an information frame are passed over."""
    at, end = 0, len(data)
    if data[:3] == b"ID3":
        require(len(data) >= 10 and not any(b & 0x80 for b in data[6:10]), "MP3_BAD_ID3")
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]) + (10 if data[5] & 0x10 else 0)
    if data[-128:-125] == b"TAG":
        end -= 128
    n = 0
    while at + 4 <= end:
        if data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
            at += 1
            continue
        version, _, kbps, rate, size, samples = mp3_header(data[at : at + 4])
        if at + size > end:
            break
        frame = data[at : at + size]
        info = any(t in frame[4:44] for t in (b"Xing", b"Info", b"VBRI"))
        if n or not info:
            n += 1
            yield n, at, version, kbps, rate, size, samples, frame
        at += size
    require(n, "MP3_NO_FRAMES")


def canonical_mp3(data: bytes) -> bytes:
    """The leading tag, an information frame, all audio frames and the trailing tag; what lies between them is dropped."""
    frames = list(mp3_frames(data))
    require(all(f[2] != 25 for f in frames), "MP3_MPEG25_ENCODE")
    tag = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]) + (10 if data[5] & 0x10 else 0) if data[:3] == b"ID3" else 0
    first, info = frames[0][1], b""
    for at in range(tag, first - 3):
        if data[at] == 0xFF and data[at + 1] & 0xE0 == 0xE0:
            info = data[at : at + mp3_header(data[at : at + 4])[4]]
            break
    return data[:tag] + info + b"".join(f[-1] for f in frames) + (data[-128:] if data[-128:-125] == b"TAG" else b"")


def canonical_adts(data: bytes) -> bytes:
    """All frames without what follows the last one."""
    return b"".join(data[f[1] : f[1] + f[5]] for f in adts_frames(data))


def build_mp3(payloads: list[bytes], kbps: int = 128, rate: int = 44100) -> bytes:
    """Frames of one size, each filled up with a payload."""
    h = bytes([0xFF, 0xFB, KBPS[1, 3].index(kbps) << 4 | MP3_RATES[1].index(rate) << 2, 0xC4])
    size = mp3_header(h)[4]
    require(all(len(p) <= size - 4 for p in payloads), "MP3_PAYLOAD")
    return b"".join(h + p + bytes(size - 4 - len(p)) for p in payloads)


ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def adts_frames(data: bytes) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """ordinal, offset, profile, sample_rate, channels, size, payload; a little junk may follow."""
    at, n = 0, 0
    while at + 7 <= len(data):
        h = data[at:]
        if h[0] != 0xFF or h[1] & 0xF6 != 0xF0:
            require(n and len(data) - at <= 4096, "ADTS_LOST_SYNC", str(at))
            break
        profile, rate_i, channels = (h[2] >> 6) + 1, h[2] >> 2 & 15, (h[2] & 1) << 2 | h[3] >> 6
        size, head = (h[3] & 3) << 11 | h[4] << 3 | h[5] >> 5, 7 if h[1] & 1 else 9
        require(rate_i < 13 and channels, "ADTS_UNSUPPORTED")
        require(not h[6] & 3, "ADTS_MULTI_BLOCK")
        require(size >= head and at + size <= len(data), "ADTS_TRUNCATED")
        n += 1
        yield n, at, profile, ADTS_RATES[rate_i], channels, size, data[at + head : at + size]
        at += size
    require(n, "ADTS_NO_FRAMES")


def build_adts(payloads: list[bytes], rate: int = 44100, channels: int = 2, profile: int = 2) -> bytes:
    out, r = bytearray(), ADTS_RATES.index(rate)
    for p in payloads:
        n = len(p) + 7
        require(n < 1 << 13, "ADTS_FRAME_TOO_LARGE")
        out += bytes([0xFF, 0xF1, (profile - 1) << 6 | r << 2 | channels >> 2, (channels & 3) << 6 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 0x1F, 0xFC]) + p
    return bytes(out)


def flac_info(data: bytes) -> tuple[int, int, int, int, int, int, int]:
    """min_block, max_block, sample_rate, channels, bits, total_samples and where the frames begin."""
    require(data[:4] == b"fLaC", "FLAC_BAD_MAGIC")
    at, info = 4, None
    while True:
        require(at + 4 <= len(data), "FLAC_TRUNCATED")
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4])
        require(info is not None or kind == 0 and size == 34, "FLAC_NO_STREAMINFO")
        if info is None:
            b = data[at + 4 : at + 38]
            packed = int.from_bytes(b[10:18])
            info = int.from_bytes(b[:2]), int.from_bytes(b[2:4]), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
        last = data[at] & 0x80
        at += 4 + size
        if last:
            return (*info, at)


def _varint(b: bytes, at: int) -> tuple[int, int]:
    """A number coded like UTF-8, up to seven bytes; value and length."""
    first, n = b[at], 0
    while first & 0x80 >> n:
        n += 1
    require(n != 1 and n <= 7, "FLAC_BAD_NUMBER")
    if not n:
        return first, 1
    v = first & 0x7F >> n
    for x in b[at + 1 : at + n]:
        require(x & 0xC0 == 0x80, "FLAC_BAD_NUMBER")
        v = v << 6 | x & 0x3F
    return v, n


def to_varint(v: int) -> bytes:
    if v < 0x80:
        return bytes([v])
    n = next(k for k in range(2, 8) if v < 1 << (5 * k + 1))
    return bytes([(0xFF00 >> n & 0xFF) | v >> 6 * (n - 1)] + [0x80 | v >> 6 * k & 0x3F for k in range(n - 2, -1, -1)])


def _flac_head(data: bytes, at: int) -> tuple[int, int, int] | None:
    """block size, number and header length, if a header with the right CRC-8 is here."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    block, rate = data[at + 2] >> 4, data[at + 2] & 15
    if not block or rate == 15:
        return None
    try:
        number, n = _varint(data, at + 4)
    except (FormatError, IndexError):
        return None
    p = at + 4 + n
    if p + 2 > len(data):
        return None
    if block == 6:
        size, p = data[p] + 1, p + 1
    elif block == 7:
        size, p = int.from_bytes(data[p : p + 2]) + 1, p + 2
    else:
        size = 192 if block == 1 else 576 << (block - 2) if 2 <= block <= 5 else 256 << (block - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    return size, number, p + 1 - at


def flac_frames(data: bytes) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """ordinal, offset, block_size, number, sample_rate, size and bytes of each frame whose CRC-16 holds; a frame ends where the next begins."""
    *info, at = flac_info(data)
    starts = [p for p in range(at, len(data)) if data[p] == 0xFF and _flac_head(data, p)]
    n, i = 0, 0
    while i < len(starts):
        # A sync pattern inside a payload is no frame: the checksum decides how far the frame goes.
        for j in range(i + 1, len(starts) + 1):
            frame = data[starts[i] : starts[j] if j < len(starts) else len(data)]
            if crc16(frame[:-2]) == int.from_bytes(frame[-2:]):
                size, number, _ = _flac_head(data, starts[i])
                n += 1
                yield n, starts[i], size, number, info[2], len(frame), frame
                i = j
                break
        else:
            i += 1


def build_flac(payloads: list[bytes], rate: int = 44100, channels: int = 2, bits: int = 16, block: int = 4096) -> bytes:
    info = struct.pack(">HH", block, block) + bytes(6) + (rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | block * len(payloads)).to_bytes(8) + bytes(16)
    out = bytearray(b"fLaC\x80\x00\x00\x22" + info)
    for i, p in enumerate(payloads):
        head = bytes([0xFF, 0xF8, 0xC0 | 9, (channels - 1) << 4 | 4 << 1]) + to_varint(i)
        frame = head + bytes([crc8(head)]) + p
        out += frame + struct.pack(">H", crc16(frame))
    return bytes(out)
