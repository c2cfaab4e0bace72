"""Cyclic checksums that Spark has not: by polynomial, width and direction."""

from __future__ import annotations

from functools import cache


@cache
def table(width: int, poly: int) -> tuple[int, ...]:
    """Of a register that shifts to the left."""
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        r = byte << (width - 8)
        for _ in range(8):
            r = (r << 1 ^ poly) & mask if r & top else r << 1 & mask
        out.append(r)
    return tuple(out)


def crc(data: bytes, width: int, poly: int, start: int = 0) -> int:
    t, mask, r, s = table(width, poly), (1 << width) - 1, start, width - 8
    for b in data:
        r = (r << 8 & mask) ^ t[(r >> s) ^ b]
    return r


def crc8(data: bytes) -> int:
    """FLAC frame headers."""
    return crc(data, 8, 0x07)


def crc16(data: bytes) -> int:
    """FLAC frames."""
    return crc(data, 16, 0x8005)


def crc32_ogg(data: bytes) -> int:
    return crc(data, 32, 0x04C11DB7)


def crc32_psi(data: bytes) -> int:
    """MPEG-2 section tables."""
    return crc(data, 32, 0x04C11DB7, 0xFFFFFFFF)
