"""Still images: (width, height, channels, bit_depth, pixels) from and to bytes. Rows run top to bottom, samples big-endian."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from formloom.errors import FormatError, require

MAX_PIXELS, MAX_SIDE = 100_000_000, 16_384


@dataclass
class Image:
    width: int
    height: int
    channels: int
    bit_depth: int
    pixels: bytes
    note: str = ""


def sized(width: int, height: int) -> None:
    require(0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE and width * height <= MAX_PIXELS, "IMAGE_SIZE", f"{width}x{height}")


def _take(data: bytes, at: int, n: int) -> bytes:
    require(at >= 0 and at + n <= len(data), "IMAGE_TRUNCATED")
    return data[at : at + n]


# Netpbm --------------------------------------------------------------------------------------


def _tokens(data: bytes, n: int) -> tuple[list[int], int]:
    """n numbers after the magic, and where they end; # begins a comment."""
    out, at = [], 2
    p = re.compile(rb"(?:\s|#[^\n\r]*)*([0-9]+)")
    for _ in range(n):
        m = p.match(data, at)
        require(m, "NETPBM_BAD_HEADER")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def parse_netpbm(data: bytes) -> Image:
    kind = data[:2]
    require(kind in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"), "NETPBM_BAD_MAGIC")
    bitmap, channels = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    head, at = _tokens(data, 2 if bitmap else 3)
    (w, h), top = head[:2], 1 if bitmap else head[2]
    sized(w, h)
    require(1 <= top <= 65_535, "NETPBM_MAXVAL")
    n = w * h * channels
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        v = re.findall(rb"[01]", body) if bitmap else body.split()
        require(len(v) == n if not bitmap else len(v) >= n, "NETPBM_SAMPLE_COUNT")
        x = np.array([int(t) for t in v[:n]], np.int64)
        require(not n or x.max() <= top, "NETPBM_SAMPLE_RANGE")
    elif bitmap:
        rows = np.frombuffer(_take(data, at + 1, (w + 7) // 8 * h), np.uint8).reshape(h, -1)
        x = np.unpackbits(rows, axis=1)[:, :w].ravel()
    else:
        x = np.frombuffer(_take(data, at + 1, n * (2 if top > 255 else 1)), ">u2" if top > 255 else np.uint8)
        require(x.max() <= top, "NETPBM_SAMPLE_RANGE")
    return Image(w, h, channels, 1 if bitmap else 16 if top > 255 else 8, x.astype(">u2" if top > 255 else np.uint8).tobytes(), f"maxval={top}")


def build_netpbm(im: Image) -> bytes:
    """The binary forms: P4 for one bit, else P5 or P6."""
    if im.bit_depth == 1:
        return b"P4\n%d %d\n" % (im.width, im.height) + np.packbits(np.frombuffer(im.pixels, np.uint8).reshape(im.height, im.width), axis=1).tobytes()
    return b"P%d\n%d %d\n%d\n" % (5 if im.channels == 1 else 6, im.width, im.height, 65_535 if im.bit_depth == 16 else 255) + im.pixels


def parse_pfm(data: bytes) -> Image:
    m = re.match(rb"P([fF])\s+(\d+)\s+(\d+)\s+([+-]?[0-9.eE+-]+)[ \t\r\n]", data)
    require(m, "PFM_BAD_HEADER")
    w, h, c, scale = int(m[2]), int(m[3]), 3 if m[1] == b"F" else 1, float(m[4])
    sized(w, h)
    require(scale and np.isfinite(scale), "PFM_SCALE")
    x = np.frombuffer(_take(data, m.end(), 4 * w * h * c), "<f4" if scale < 0 else ">f4").reshape(h, w * c)
    return Image(w, h, c, 32, x[::-1].astype(">f4").tobytes(), "bottom-up")  # the file's first row is the lowest


def build_pfm(im: Image) -> bytes:
    x = np.frombuffer(im.pixels, ">f4").reshape(im.height, -1)[::-1]
    return b"P%s\n%d %d\n-1.0\n" % (b"F" if im.channels == 3 else b"f", im.width, im.height) + x.astype("<f4").tobytes()


# QOI -----------------------------------------------------------------------------------------


def parse_qoi(data: bytes) -> Image:
    require(data[:4] == b"qoif" and len(data) >= 22, "QOI_BAD_MAGIC")
    w, h, c, space = struct.unpack(">IIBB", data[4:14])
    sized(w, h)
    require(c in (3, 4) and space in (0, 1), "QOI_BAD_HEADER")
    seen, px, out, at, end = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), [], 14, len(data) - 8
    require(data[end:] == bytes(7) + b"\1", "QOI_END_MARKER")
    while len(out) < w * h:
        require(at < end, "QOI_TRUNCATED")
        b, run = data[at], 1
        at += 1
        r, g, bl, a = px
        if b == 0xFE:
            px, at = (*data[at : at + 3], a), at + 3
        elif b == 0xFF:
            px, at = tuple(data[at : at + 4]), at + 4
        elif b >> 6 == 0:
            px = seen[b]
        elif b >> 6 == 1:
            px = ((r + (b >> 4 & 3) - 2) & 255, (g + (b >> 2 & 3) - 2) & 255, (bl + (b & 3) - 2) & 255, a)
        elif b >> 6 == 2:
            dg, e = (b & 63) - 32, data[at]
            px, at = ((r + dg + (e >> 4) - 8) & 255, (g + dg) & 255, (bl + dg + (e & 15) - 8) & 255, a), at + 1
        else:
            run = (b & 63) + 1
        seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64] = px
        out += [px] * run
    require(len(out) == w * h and at == end, "QOI_PIXEL_COUNT")
    return Image(w, h, c, 8, b"".join(bytes(p[:c]) for p in out))


def build_qoi(im: Image) -> bytes:
    c, raw = im.channels, im.pixels
    out, seen, last, run = bytearray(b"qoif" + struct.pack(">IIBB", im.width, im.height, c, 0)), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for i in range(0, len(raw), c):
        px = (*raw[i : i + 3], raw[i + 3] if c == 4 else 255)
        if px == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        slot = (px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64
        dr, dg, db = ((x - y + 128) % 256 - 128 for x, y in zip(px[:3], last[:3], strict=True))
        if seen[slot] == px:
            out.append(slot)
        elif px[3] != last[3]:
            out += bytes([0xFF, *px])
        elif all(-2 <= d < 2 for d in (dr, dg, db)):
            out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
        elif -32 <= dg < 32 and -8 <= dr - dg < 8 and -8 <= db - dg < 8:
            out += bytes([0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8])
        else:
            out += bytes([0xFE, *px[:3]])
        seen[slot] = last = px
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + bytes(7) + b"\1"


# BMP and ICO ---------------------------------------------------------------------------------


def build_bmp(im: Image) -> bytes:
    """24 or 32 bits, bottom-up, rows padded to four bytes."""
    x = np.frombuffer(im.pixels, np.uint8).reshape(im.height, im.width, im.channels)
    x = np.repeat(x, 3, axis=2) if im.channels == 1 else x
    x = (x[..., [2, 1, 0, 3]] if x.shape[2] == 4 else x[..., ::-1])[::-1]
    rows = x.reshape(im.height, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, im.width, im.height, 1, 8 * x.shape[2], 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def parse_bmp(data: bytes) -> Image:
    require(data[:2] == b"BM" and len(data) >= 54, "BMP_BAD_MAGIC")
    (at,) = struct.unpack_from("<I", data, 10)
    _, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    require(bits in (24, 32) and packing in (0, 3), "BMP_UNSUPPORTED")
    sized(w, abs(h))
    c = bits // 8
    stride = -(-w * c // 4) * 4
    x = np.frombuffer(_take(data, at, stride * abs(h)), np.uint8).reshape(abs(h), stride)[:, : w * c].reshape(abs(h), w, c)
    x = x[::-1] if h > 0 else x
    return Image(w, abs(h), c, 8, np.ascontiguousarray(x[..., [2, 1, 0, 3]] if c == 4 else x[..., ::-1]).tobytes())


def build_ico(images: list[tuple[int, int, bytes]]) -> bytes:
    """A directory over whole images (width, height, PNG or other payload)."""
    at, out, bodies = 6 + 16 * len(images), struct.pack("<HHH", 0, 1, len(images)), b""
    for w, h, body in images:
        require(0 < w <= 256 and 0 < h <= 256, "ICO_SIZE")
        out += struct.pack("<BBBBHHII", w & 255, h & 255, 0, 0, 1, 32, len(body), at + len(bodies))
        bodies += body
    return out + bodies


def ico_images(data: bytes):
    """ordinal, width, height and payload of each image."""
    zero, kind, n = struct.unpack_from("<HHH", _take(data, 0, 6))
    require((zero, kind) == (0, 1) and n, "ICO_BAD_HEADER")
    for i in range(n):
        w, h, _, _, _, _, size, at = struct.unpack("<BBBBHHII", _take(data, 6 + 16 * i, 16))
        yield i + 1, w or 256, h or 256, _take(data, at, size)


# TGA, PCX, TIFF and their run lengths --------------------------------------------------------


def unpack_bits(data: bytes, n: int) -> bytes:
    """PackBits: n bytes of literal runs and repeats."""
    out, at = bytearray(), 0
    while len(out) < n:
        require(at < len(data), "PACKBITS_TRUNCATED")
        b = data[at]
        if b < 128:
            out += _take(data, at + 1, b + 1)
            at += b + 2
        elif b > 128:
            out += _take(data, at + 1, 1) * (257 - b)
            at += 2
        else:
            at += 1
    require(len(out) == n, "PACKBITS_OVERRUN")
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out = bytearray()
    for m in re.finditer(rb"(?s)(.)\1{1,127}|(?:(.)(?!\2)){1,128}", data):
        out += bytes([257 - len(m[0])]) + m[1] if m[1] is not None else bytes([len(m[0]) - 1]) + m[0]
    return bytes(out)


def parse_tga(data: bytes) -> Image:
    id_len, map_type, kind, _, map_len, map_bits, _, _, w, h, bits, flags = struct.unpack("<BBBHHBHHHHBB", _take(data, 0, 18))
    sized(w, h)
    require(kind in (2, 3, 10, 11) and bits in ((8,) if kind in (3, 11) else (24, 32)), "TGA_UNSUPPORTED")
    at, c = 18 + id_len + (map_len * -(-map_bits // 8) if map_type else 0), bits // 8
    if kind < 8:
        raw = _take(data, at, w * h * c)
    else:
        out, need = bytearray(), w * h * c
        while len(out) < need:
            (b,) = _take(data, at, 1)
            n = (b & 127) + 1
            out += _take(data, at + 1, c) * n if b & 128 else _take(data, at + 1, c * n)
            at += 1 + (c if b & 128 else c * n)
        require(len(out) == need, "TGA_RLE_OVERRUN")
        raw = bytes(out)
    x = np.frombuffer(raw, np.uint8).reshape(h, w, c)
    x = x if flags & 0x20 else x[::-1]
    x = x[:, ::-1] if flags & 0x10 else x
    if c > 1:
        x = x[..., [2, 1, 0, 3][:c]]
    return Image(w, h, c, 8, np.ascontiguousarray(x).tobytes(), "rle" if kind > 8 else "")


def build_tga(im: Image, rle: bool = False) -> bytes:
    x = np.frombuffer(im.pixels, np.uint8).reshape(im.height, im.width, im.channels)
    raw = np.ascontiguousarray(x[..., [2, 1, 0, 3][: im.channels]] if im.channels > 1 else x).tobytes()
    kind = (3 if im.channels == 1 else 2) + (8 if rle else 0)
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, kind, 0, 0, 0, 0, 0, im.width, im.height, 8 * im.channels, 0x20 | (8 if im.channels == 4 else 0))
    if not rle:
        return head + raw
    c, out = im.channels, bytearray()
    px = [raw[i : i + c] for i in range(0, len(raw), c)]
    for y in range(im.height):  # packets do not cross rows
        row, i = px[y * im.width : (y + 1) * im.width], 0
        while i < len(row):
            n = 1
            while n < 128 and i + n < len(row) and row[i + n] == row[i]:
                n += 1
            out += bytes([127 + n]) + row[i] if n > 1 else b"\0" + row[i]
            i += n
    return head + bytes(out)


def parse_pcx(data: bytes) -> Image:
    require(data[:1] == b"\n" and len(data) >= 128, "PCX_BAD_MAGIC")
    coding, bits, x0, y0, x1, y1 = struct.unpack_from("<BBHHHH", data, 2)
    planes, stride = data[65], int.from_bytes(data[66:68], "little")
    w, h = x1 - x0 + 1, y1 - y0 + 1
    sized(w, h)
    require(coding == 1 and bits == 8 and planes in (1, 3) and stride >= w, "PCX_UNSUPPORTED")
    out, at, need = bytearray(), 128, stride * planes * h
    while len(out) < need:
        (b,) = _take(data, at, 1)
        if b >= 0xC0:
            out += _take(data, at + 1, 1) * (b & 63)
            at += 2
        else:
            out.append(b)
            at += 1
    require(len(out) == need, "PCX_RLE_OVERRUN")
    x = np.frombuffer(bytes(out), np.uint8).reshape(h, planes, stride)[:, :, :w].transpose(0, 2, 1)
    return Image(w, h, planes, 8, np.ascontiguousarray(x).tobytes())


def build_pcx(im: Image) -> bytes:
    stride = im.width + (im.width & 1)
    head = bytearray(128)
    head[:12] = struct.pack("<BBBBHHHH", 10, 5, 1, 8, 0, 0, im.width - 1, im.height - 1)
    head[65:68] = struct.pack("<BH", im.channels, stride)
    x = np.frombuffer(im.pixels, np.uint8).reshape(im.height, im.width, im.channels).transpose(0, 2, 1)
    rows = np.pad(x, ((0, 0), (0, 0), (0, stride - im.width))).reshape(-1, stride)
    out = bytearray()
    for row in rows:
        for m in re.finditer(rb"(?s)(.)\1{0,62}", row.tobytes()):
            out += bytes([0xC0 | len(m[0])]) + m[1] if len(m[0]) > 1 or m[1][0] >= 0xC0 else m[1]
    return bytes(head + out)


def tiff_lzw(data: bytes, n: int) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one early."""
    bits, have, at, out, width = 0, 0, 0, bytearray(), 9
    book: list[bytes] = []
    before: bytes | None = None
    while True:
        while have < width and at < len(data):
            bits, have, at = (bits << 8 | data[at]) & 0xFFFFFFFF, have + 8, at + 1
        if have < width:
            break
        code, have = bits >> have - width & (1 << width) - 1, have - width
        if code == 257:
            break
        if code == 256:
            book, before, width = [bytes([i]) for i in range(256)] + [b"", b""], None, 9
            continue
        require(book, "TIFF_LZW_NO_CLEAR")
        if before is None:
            word = book[code]
        else:
            require(code <= len(book), "TIFF_LZW_BAD_CODE")
            word = book[code] if code < len(book) else before + before[:1]
            book.append(before + word[:1])
        out += word
        before = word
        require(len(out) <= n, "TIFF_LZW_OVERRUN")
        width = 9 if len(book) < 511 else 10 if len(book) < 1023 else 11 if len(book) < 2047 else 12
    require(len(out) == n, "TIFF_LZW_TRUNCATED")
    return bytes(out)


def parse_tiff(data: bytes) -> Image:
    """The first image: strips, gray or RGB(A), 8 or 16 bits; plain, LZW, Deflate or PackBits, with or without a predictor."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    require(order, "TIFF_BAD_MAGIC")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack(order + "H", _take(data, at, 2))
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HHI", _take(data, at + 2 + 12 * i, 8))
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            size = struct.calcsize(code) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack(f"{order}{count}{code}", _take(data, where, size))
    require(256 in tags and 257 in tags and 273 in tags, "TIFF_MISSING_TAG")
    w, h = tags[256][0], tags[257][0]
    sized(w, h)
    depth, packing, look, c = set(tags.get(258, (1,))), tags.get(259, (1,))[0], tags.get(262, (1,))[0], tags.get(277, (1,))[0]
    require(depth in ({8}, {16}) and look in (0, 1, 2) and tags.get(284, (1,))[0] == 1 and 322 not in tags, "TIFF_UNSUPPORTED")
    wide = depth.pop() // 8
    rows = min(h, tags.get(278, (h,))[0])
    out = bytearray()
    for i, (p, size) in enumerate(zip(tags[273], tags.get(279, (len(data),)), strict=False)):
        raw, need = _take(data, p, min(size, len(data) - p)), w * c * wide * min(rows, h - i * rows)
        if packing == 1:
            out += _take(raw, 0, need)
        elif packing == 5:
            out += tiff_lzw(raw, need)
        elif packing == 32773:
            out += unpack_bits(raw, need)
        elif packing in (8, 32946):
            out += zlib.decompress(raw)[:need]
        else:
            raise FormatError("TIFF_COMPRESSION", str(packing))
    x = np.frombuffer(_take(bytes(out), 0, w * h * c * wide), ("<u2" if order == "<" else ">u2") if wide == 2 else np.uint8).reshape(h, w, c)
    if tags.get(317, (1,))[0] == 2:
        x = np.cumsum(x, axis=1, dtype=x.dtype.newbyteorder("="))
    if look == 0:
        x = (65_535 if wide == 2 else 255) - x
    return Image(w, h, c, 8 * wide, x.astype(">u2" if wide == 2 else np.uint8).tobytes())


def build_tiff(im: Image, packing: int = 1) -> bytes:
    """Little-endian, one strip; 1 plain, 8 Deflate, 32773 PackBits."""
    x = np.frombuffer(im.pixels, ">u2" if im.bit_depth == 16 else np.uint8).astype("<u2" if im.bit_depth == 16 else np.uint8).tobytes()
    body = {1: lambda: x, 8: lambda: zlib.compress(x), 32773: lambda: pack_bits(x)}[packing]()
    c, at = im.channels, 8
    depth = at + len(body) + (len(body) & 1)
    tags = [(256, 4, 1, im.width), (257, 4, 1, im.height), (258, 3, c, im.bit_depth if c == 1 else depth), (259, 3, 1, packing), (262, 3, 1, 1 if c == 1 else 2), (273, 4, 1, at), (277, 3, 1, c), (278, 4, 1, im.height), (279, 4, 1, len(body))]
    extra = struct.pack(f"<{c}H", *[im.bit_depth] * c)
    return b"II*\0" + struct.pack("<I", depth + len(extra)) + body + bytes(len(body) & 1) + extra + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)


# XBM, XPM and ICNS ---------------------------------------------------------------------------


def parse_xbm(data: bytes) -> Image:
    t = data.decode("latin-1")
    size = {k: int(v) for k, v in re.findall(r"#define\s+\S*_(width|height)\s+(\d+)", t)}
    body = re.search(r"_bits\s*\[\s*\]\s*=\s*\{([^}]*)\}", t)
    require(set(size) == {"width", "height"} and body, "XBM_BAD_HEADER")
    w, h = size["width"], size["height"]
    sized(w, h)
    v = [int(x, 0) for x in re.findall(r"0[xX][0-9a-fA-F]+|\d+", body[1])]
    stride = (w + 7) // 8
    require(len(v) == stride * h and max(v) < 256, "XBM_DATA_COUNT")
    x = np.unpackbits(np.array(v, np.uint8).reshape(h, stride), axis=1, bitorder="little")[:, :w]
    return Image(w, h, 1, 1, np.ascontiguousarray(x).tobytes())


def build_xbm(im: Image, name: str = "image") -> bytes:
    v = np.packbits(np.frombuffer(im.pixels, np.uint8).reshape(im.height, im.width), axis=1, bitorder="little").ravel()
    rows = ",\n".join("  " + ", ".join(f"0x{b:02x}" for b in v[i : i + 12]) for i in range(0, len(v), 12))
    return f"#define {name}_width {im.width}\n#define {name}_height {im.height}\nstatic unsigned char {name}_bits[] = {{\n{rows}\n}};\n".encode()


def parse_xpm(data: bytes) -> Image:
    """Colours as #RGB, #RRGGBB, None, black or white; RGBA pixels."""
    require(data.lstrip().startswith(b"/* XPM */"), "XPM_BAD_MAGIC")
    s = re.findall(r'"((?:[^"\\]|\\.)*)"', data.decode("latin-1"))
    require(s and len(s[0].split()) >= 4, "XPM_BAD_HEADER")
    w, h, n, cpp = map(int, s[0].split()[:4])
    sized(w, h)
    require(n and cpp in (1, 2, 3, 4) and len(s) >= 1 + n + h, "XPM_BAD_HEADER")
    colours = {}
    for line in s[1 : 1 + n]:
        m = re.search(r"(?:^|\s)c\s+(\S+)", line[cpp:])
        require(m, "XPM_COLOUR")
        v = m[1].lower()
        v = {"none": "#00000000", "black": "#000000ff", "white": "#ffffffff"}.get(v, v)
        require(re.fullmatch("#([0-9a-f]{3}|[0-9a-f]{6}|[0-9a-f]{8})", v), "XPM_COLOUR", v)
        v = v[1:] if len(v) > 4 else "".join(x * 2 for x in v[1:])
        colours[line[:cpp]] = bytes.fromhex(v if len(v) == 8 else v + "ff")
    rows = s[1 + n : 1 + n + h]
    require(all(len(r) == w * cpp for r in rows), "XPM_ROW_LENGTH")
    try:
        return Image(w, h, 4, 8, b"".join(colours[r[i : i + cpp]] for r in rows for i in range(0, w * cpp, cpp)))
    except KeyError as e:
        raise FormatError("XPM_UNKNOWN_KEY", str(e)) from None


def build_xpm(im: Image, name: str = "image") -> bytes:
    px = [im.pixels[i : i + 4] for i in range(0, len(im.pixels), 4)]
    alphabet = [chr(c) for c in range(35, 91)]
    cpp, keys = 1, {}
    colours = list(dict.fromkeys(px))
    while len(alphabet) ** cpp < len(colours):
        cpp += 1
    for i, c in enumerate(colours):
        k = ""
        for _ in range(cpp):
            i, d = divmod(i, len(alphabet))
            k += alphabet[d]
        keys[c] = k
    lines = [f"{im.width} {im.height} {len(colours)} {cpp}", *[f"{k} c {'None' if not c[3] else '#' + c[:3].hex()}" for c, k in keys.items()]]
    lines += ["".join(keys[p] for p in px[y * im.width : (y + 1) * im.width]) for y in range(im.height)]
    return ("/* XPM */\nstatic char *" + name + "[] = {\n" + ",\n".join(f'"{x}"' for x in lines) + "\n};\n").encode()


def icns_elements(data: bytes):
    """ordinal, type and payload."""
    require(data[:4] == b"icns" and int.from_bytes(data[4:8]) == len(data), "ICNS_BAD_HEADER")
    at, n = 8, 0
    while at < len(data):
        size = int.from_bytes(_take(data, at + 4, 4))
        require(size >= 8, "ICNS_BAD_ELEMENT")
        n += 1
        yield n, data[at : at + 4].decode("latin-1"), _take(data, at, size)[8:]
        at += size


def build_icns(elements: list[tuple[str, bytes]]) -> bytes:
    body = b"".join(k.encode("latin-1") + (8 + len(v)).to_bytes(4) + v for k, v in elements)
    return b"icns" + (8 + len(body)).to_bytes(4) + body


PARSE = {"pbm": parse_netpbm, "pgm": parse_netpbm, "ppm": parse_netpbm, "pfm": parse_pfm, "qoi": parse_qoi, "bmp": parse_bmp, "tga": parse_tga, "pcx": parse_pcx, "tiff": parse_tiff, "xbm": parse_xbm, "xpm": parse_xpm}
BUILD = {"pbm": build_netpbm, "pgm": build_netpbm, "ppm": build_netpbm, "pfm": build_pfm, "qoi": build_qoi, "bmp": build_bmp, "tga": build_tga, "pcx": build_pcx, "tiff": build_tiff, "xbm": build_xbm, "xpm": build_xpm}
