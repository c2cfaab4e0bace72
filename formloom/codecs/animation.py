"""Animations: frames of GIF (decoded), APNG and WebP (payloads as they are)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from formloom.codecs.image import sized
from formloom.errors import require

MAX_FRAMES = 10_000
#: ordinal, x, y, width, height, duration_ms, disposal, blend, payload
Frame = tuple[int, int, int, int, int, int, int, int, bytes]


def gif_lzw(data: bytes, least: int, n: int) -> bytes:
    """n pixels from codes that start at least + 1 bits, lowest bit first."""
    require(2 <= least <= 8, "GIF_LZW_SIZE")
    clear, width, bits, have, out, before = 1 << least, least + 1, 0, 0, bytearray(), None
    book = [bytes([i]) for i in range(clear)] + [b"", b""]
    for b in data:
        bits, have = bits | b << have, have + 8
        while have >= width:
            code, bits, have = bits & (1 << width) - 1, bits >> width, have - width
            if code == clear:
                del book[clear + 2 :]
                width, before = least + 1, None
                continue
            if code == clear + 1 or len(out) >= n:
                return _exact(out, n)
            if before is None:
                require(code < clear, "GIF_LZW_BAD_CODE")
                word = book[code]
            else:
                require(code <= len(book), "GIF_LZW_BAD_CODE")
                word = book[code] if code < len(book) else before + before[:1]
                if len(book) < 4096:
                    book.append(before + word[:1])
            out += word
            before = word
            if len(book) == 1 << width and width < 12:
                width += 1
    return _exact(out, n)


def _exact(out: bytearray, n: int) -> bytes:
    require(len(out) == n, "GIF_LZW_LENGTH")
    return bytes(out)


def gif_lzw_encode(pixels: bytes, least: int) -> bytes:
    clear, width, bits, have, out = 1 << least, least + 1, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal bits, have
        bits |= code << have
        have += width
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    put(clear)
    book, word = {bytes([i]): i for i in range(clear)}, b""
    for b in pixels:
        longer = word + bytes([b])
        if longer in book:
            word = longer
            continue
        put(book[word])
        size = len(book) + 2
        if size < 4096:
            book[longer] = size
            if size == 1 << width and width < 12:
                width += 1
        else:
            put(clear)
            book, width = {bytes([i]): i for i in range(clear)}, least + 1
        word = bytes([b])
    if word:
        put(book[word])
    put(clear + 1)
    if have:
        out.append(bits & 255)
    return bytes(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while True:
        require(at < len(data), "GIF_TRUNCATED")
        n = data[at]
        out += data[at + 1 : at + 1 + n]
        at += 1 + n
        if not n:
            return bytes(out), at


def gif_frames(data: bytes) -> Iterator[Frame]:
    """Frames with their pixels as palette numbers, rows in order even if interlaced."""
    require(data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 13, "GIF_BAD_MAGIC")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    sized(w, h)
    at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    n, delay, disposal = 0, 0, 0
    while True:
        require(at < len(data), "GIF_TRUNCATED")
        kind, at = data[at], at + 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10
            continue
        require(kind == 0x2C, "GIF_BAD_BLOCK")
        x, y, fw, fh, local = struct.unpack_from("<HHHHB", data, at)
        require(fw and fh and x + fw <= w and y + fh <= h, "GIF_FRAME_BOUNDS")
        at += 9 + (3 << (local & 7) + 1 if local & 0x80 else 0)
        least = data[at]
        packed, at = _blocks(data, at + 1)
        px = gif_lzw(packed, least, fw * fh)
        if local & 0x40:
            order = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, fh, d)]
            rows = {r: px[i * fw : (i + 1) * fw] for i, r in enumerate(order)}
            px = b"".join(rows[r] for r in range(fh))
        n += 1
        require(n <= MAX_FRAMES, "GIF_TOO_MANY_FRAMES")
        yield n, x, y, fw, fh, delay, disposal, 0, px
        delay, disposal = 0, 0


def build_gif(width: int, height: int, palette: bytes, frames: list[tuple[int, int, int, int, int, int, bytes]]) -> bytes:
    """frames: x, y, width, height, duration_ms, disposal, pixels; a global palette of 2 to 256 colours."""
    size = max(2, (len(palette) // 3 - 1).bit_length())
    out = bytearray(b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | size - 1, 0, 0) + palette + bytes((3 << size) - len(palette)))
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    for x, y, w, h, ms, disposal, px in frames:
        packed = gif_lzw_encode(px, size)
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2, ms // 10, 0, 0) + b"\x2c" + struct.pack("<HHHHBB", x, y, w, h, 0, size)
        for i in range(0, len(packed), 255):
            out += bytes([len(packed[i : i + 255])]) + packed[i : i + 255]
        out.append(0)
    return bytes(out) + b";"


def png_chunks(data: bytes) -> Iterator[tuple[str, bytes]]:
    require(data[:8] == b"\x89PNG\r\n\x1a\n", "PNG_BAD_MAGIC")
    at = 8
    while at < len(data):
        size = int.from_bytes(data[at : at + 4])
        body = data[at + 4 : at + 8 + size]
        require(len(body) == 4 + size and zlib.crc32(body) == int.from_bytes(data[at + 8 + size : at + 12 + size]), "PNG_CRC")
        yield body[:4].decode("latin-1"), body[4:]
        at += 12 + size


def png_chunk(kind: str, body: bytes) -> bytes:
    raw = kind.encode() + body
    return len(body).to_bytes(4) + raw + zlib.crc32(raw).to_bytes(4)


def apng_frames(data: bytes) -> Iterator[Frame]:
    """Frames in order of their control chunks; payloads are their compressed data, parts joined."""
    size, frames, control, seq, held, declared = None, 0, None, 0, b"", None
    for kind, body in png_chunks(data):
        if kind == "IHDR":
            size = struct.unpack(">II", body[:8])
            sized(*size)
        elif kind == "acTL":
            declared = int.from_bytes(body[:4])
        elif kind in ("fcTL", "fdAT"):
            require(int.from_bytes(body[:4]) == seq, "APNG_SEQUENCE")
            seq += 1
            if kind == "fdAT":
                require(control, "APNG_DATA_WITHOUT_CONTROL")
                held += body[4:]
                continue
            if control:
                frames += 1
                yield (frames, *control, held)
            w, h, x, y, a, b, disposal, blend = struct.unpack(">IIIIHHBB", body[4:26])
            require(size and w and h and x + w <= size[0] and y + h <= size[1], "APNG_FRAME_BOUNDS")
            control, held = (x, y, w, h, a * 1000 // (b or 100), disposal, blend), b""
        elif kind == "IDAT" and control:
            held += body
    if control:
        frames += 1
        yield (frames, *control, held)
    require(declared is not None and declared == frames, "APNG_FRAME_COUNT")


def build_apng(width: int, height: int, frames: list[tuple[int, int, int, int, int, int, int, bytes]], colour: int = 0) -> bytes:
    """frames: x, y, width, height, duration_ms, disposal, blend, compressed data; the first is the default image."""
    out = b"\x89PNG\r\n\x1a\n" + png_chunk("IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + png_chunk("acTL", struct.pack(">II", len(frames), 0))
    seq = 0
    for i, (x, y, w, h, ms, disposal, blend, body) in enumerate(frames):
        out += png_chunk("fcTL", struct.pack(">IIIIIHHBB", seq, w, h, x, y, ms, 1000, disposal, blend))
        out += png_chunk("fdAT", struct.pack(">I", seq + 1) + body) if i else png_chunk("IDAT", body)
        seq += 2 if i else 1
    return out + png_chunk("IEND", b"")


def webp_frames(data: bytes) -> Iterator[Frame]:
    """ANMF frames: offsets count in twos, sizes one more than stored."""
    require(data[:4] == b"RIFF" and data[8:12] == b"WEBP" and int.from_bytes(data[4:8], "little") + 8 <= len(data), "WEBP_BAD_HEADER")
    at, n, canvas, loops = 12, 0, None, False
    u24 = lambda b, i: int.from_bytes(b[i : i + 3], "little")
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        require(len(body) == size, "WEBP_TRUNCATED")
        if kind == b"VP8X":
            canvas = u24(body, 4) + 1, u24(body, 7) + 1
            sized(*canvas)
        elif kind == b"ANIM":
            loops = True
        elif kind == b"ANMF":
            require(canvas and loops and size >= 16, "WEBP_ORDER")
            x, y, w, h = u24(body, 0) * 2, u24(body, 3) * 2, u24(body, 6) + 1, u24(body, 9) + 1
            require(x + w <= canvas[0] and y + h <= canvas[1], "WEBP_FRAME_BOUNDS")
            n += 1
            yield n, x, y, w, h, u24(body, 12), body[15] & 1, 1 - (body[15] >> 1 & 1), body[16:]
        at += 8 + size + (size & 1)
    require(n, "WEBP_NOT_ANIMATED")


def build_webp(width: int, height: int, frames: list[tuple[int, int, int, int, int, int, int, bytes]]) -> bytes:
    u24 = lambda v: v.to_bytes(3, "little")
    chunk = lambda k, b: k + len(b).to_bytes(4, "little") + b + bytes(len(b) & 1)
    body = chunk(b"VP8X", b"\x02\0\0\0" + u24(width - 1) + u24(height - 1)) + chunk(b"ANIM", bytes(6))
    for x, y, w, h, ms, disposal, blend, data in frames:
        body += chunk(b"ANMF", u24(x // 2) + u24(y // 2) + u24(w - 1) + u24(h - 1) + u24(ms) + bytes([disposal | (1 - blend) << 1]) + data)
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body
